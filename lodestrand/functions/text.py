"""Scalar text functions as Spark columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(c: str | Column) -> Column:
    """trimmed, lower case, runs of white space as one space; null becomes empty."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s", " "))), r" +", " ")


def clean_page(c: str | Column) -> Column:
    """Without quotation marks, line breaks as spaces."""
    return F.translate(F.translate(col(c), "\"'", ""), "\n", " ")


def entity_surface(c: str | Column) -> Column:
    """the part after the last bar, normalised."""
    return normalize(F.element_at(F.split(F.coalesce(col(c), F.lit("")), r"\|"), -1))


def contains_any(text: str | Column, words: Iterable[str]) -> Column:
    """whether any of the words is a substring."""
    t = F.coalesce(col(text), F.lit(""))
    out = F.lit(False)
    for w in words:
        out = out | t.contains(w)
    return out


def hits(text: str | Column, words: Iterable[str]) -> Column:
    """the words that are substrings, in the order of the list."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.coalesce(col(text), F.lit("")).contains(w))


def _ratio(a: Column, b: Column, bottom) -> Column:
    x, y = F.array_distinct(a), F.array_distinct(b)
    common = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(common / bottom(x, y))


def gate_tokens(c: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"[\x{4e00}-\x{9fff}a-z0-9_\-]+"), F.lit(0))


def overlap_max(a: str | Column, b: str | Column) -> Column:
    """common tokens over the larger token set."""
    return _ratio(gate_tokens(a), gate_tokens(b), lambda x, y: F.greatest(F.size(x), F.size(y)))


def label_tokens(c: str | Column) -> Column:
    """Words of a-z0-9_, and runs of two or more CJK characters: whole up to four, else pairs of neighbours."""
    t = normalize(c)
    words = F.regexp_extract_all(t, F.lit(r"[a-z0-9_]+"), F.lit(0))
    runs = F.regexp_extract_all(t, F.lit(r"[\x{4e00}-\x{9fff}]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) <= 4, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, 2)))))
    return F.concat(words, pairs)


def overlap_min(a: str | Column, b: str | Column) -> Column:
    """common tokens over the smaller token set."""
    return _ratio(label_tokens(a), label_tokens(b), lambda x, y: F.least(F.size(x), F.size(y)))


def retrieval_tokens(c: str | Column) -> Column:
    """Single CJK characters and words, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"[\x{4e00}-\x{9fff}]|[a-z0-9_]+"), F.lit(0)))


def overlap_jaccard(a: str | Column, b: str | Column) -> Column:
    """Jaccard overlap of retrieval tokens."""
    return _ratio(retrieval_tokens(a), retrieval_tokens(b), lambda x, y: F.size(F.array_union(x, y)))


def space_tokens(c: str | Column) -> Column:
    return F.filter(F.split(normalize(c), " "), lambda x: x != "")


def overlap_ws(a: str | Column, b: str | Column) -> Column:
    """Jaccard overlap of white-space tokens."""
    return _ratio(space_tokens(a), space_tokens(b), lambda x, y: F.size(F.array_union(x, y)))


def casualties(c: str | Column, word: str) -> Column:
    """the sum of all numbers in ``word`` N 人 or N 人 ``word``."""
    t = F.coalesce(col(c), F.lit(""))
    a = F.regexp_extract_all(t, F.lit(rf"{word}\s*(\d+)\s*人"), F.lit(1))
    b = F.regexp_extract_all(t, F.lit(rf"(\d+)\s*人\s*{word}"), F.lit(1))
    return F.aggregate(F.concat(a, b), F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint"))


def clamp01(c: str | Column) -> Column:
    """F16: at least 0, at most 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(c)))


def discretize(c: str | Column, positive: float, negative: float) -> Column:
    """F16: 1 from ``positive`` on, 0 up to ``negative``, else -1."""
    return F.when(col(c) >= positive, 1).when(col(c) <= negative, 0).otherwise(-1)


def sigmoid(c: str | Column) -> Column:
    """logistic function, its argument kept within 20 of 0."""
    x = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), col(c)))
    return 1 / (1 + F.exp(-x))


def split_bucket(key: str | Column) -> Column:
    """sha1 of the key modulo 10,000, by Horner's rule over its hexadecimal digits."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.conv(F.substring(F.sha1(col(key).cast("binary")), i, 1), 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda s, d: (s * 16 + d) % 10000)


def split_name(key: str | Column, train: float = 0.8, dev: float = 0.1) -> Column:
    """the split of a key."""
    r = split_bucket(key) / 10000
    return F.when(r < train, "train").when(r < train + dev, "dev").otherwise("test")


def relation_confidence(props: str | Column) -> Column:
    """the largest of the confidence properties; on a scale to 100 they are divided by 100 and kept to 1."""
    names = ["confidence", "score", "probability", "weight", "llm_score", "causal_score"]
    vals = F.filter(F.array(*(F.element_at(col(props), n).try_cast("double") for n in names)), lambda v: v.isNotNull() & (v >= 0))
    top = F.array_max(vals)
    return F.when(top.isNull(), F.lit(0.0)).when(top > 1, F.least(F.lit(1.0), top / 100)).otherwise(top)


def safe_name(c: str | Column) -> Column:
    """a name without the characters file systems refuse."""
    return F.regexp_replace(F.trim(col(c)), r'[\\/:*?"<>|\s]+', "_")


def clock_seconds(c: str | Column) -> Column:
    """seconds of H:MM:SS."""
    p = F.split(col(c), ":")
    return F.element_at(p, 1).try_cast("int") * 3600 + F.element_at(p, 2).try_cast("int") * 60 + F.element_at(p, 3).try_cast("int")


def seconds_clock(c: str | Column) -> Column:
    """H:MM:SS of seconds."""
    s = col(c).cast("int")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def clean_concept(c: str | Column) -> Column:
    """the last path part without its part-of-speech suffix, in lower case; null unless letters."""
    bare = F.lower(F.element_at(F.split(F.regexp_replace(col(c), r"/[navr]$", ""), "/"), -1))
    return F.when(F.regexp_replace(bare, r"[_\-]", "").rlike(r"^\p{L}+$"), bare)


def source_label(url: str | Column, name: str | Column) -> Column:
    """the url, or the file name where the url says None."""
    return F.when(col(url).contains("None"), col(name)).otherwise(F.coalesce(col(url), col(name)))


def injury_code(type_code: str | Column) -> Column:
    """WSA3 and the last four digits of the type code, filled with zeros."""
    digits = F.regexp_replace(col(type_code), r"\D", "")
    return F.when(digits != "", F.concat(F.lit("WSA3"), F.lpad(F.right(digits, F.lit(4)), 4, "0")))


def full_code(*parts: Column) -> Column:
    """the parts joined by hyphens, null if one is missing."""
    ok = F.lit(True)
    for p in parts:
        ok = ok & p.isNotNull() & (p != "")
    return F.when(ok, F.concat_ws("-", *parts))
