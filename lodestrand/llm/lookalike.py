"""Texts that look alike in one form.

Texts are exploded to positioned code points; a broadcast join with the decomposition and look-alike mappings finds the
ones to change; combining marks are put in the order of their class and recomposed; the strings are rebuilt. Two texts
have the same form if and only if they read the same on the page: width of letters, digits, marks and spaces, invisible
characters, order and composition of accents and look-alike letters of other scripts make no difference; case, accents,
raised, lowered or circled characters and line breaks do.

Only texts that hold a character that could change, or marks that could be reordered or composed, are taken apart; any
other text is its own form. Null texts have no form; empty texts have the empty form. The mappings are built by rule from
the Unicode character database and the public table of confusable characters (the ICU library that Spark brings along),
so their size is bounded by them.
"""

from __future__ import annotations

import sys
import unicodedata as ud
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.session import cut

# Kinds of compatibility decomposition that leave the look as it is.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<square>", "<small>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>"}
# Hyphens that look like the plain hyphen.
HYPHENS = "\u2010\u2011\ufe63"
# Characters that show nothing.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
#: Texts are taken apart in segments of so many characters.
SEGMENT = 512


def _decompose(c: str) -> str:
    d = ud.decomposition(c).split()
    if not d:
        return c
    if d[0].startswith("<"):
        if d[0] not in SAME_LOOK:
            return c
        d = d[1:]
    out = "".join(_decompose(chr(int(x, 16))) for x in d)
    if "<square>" in ud.decomposition(c) and out[-1:] in "23" and out[:-1].isalpha():
        return out[:-1] + {"2": "²", "3": "³"}[out[-1]]
    return out


_ALIKE: dict[str, str] = {}


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Cased letters of other scripts and the Latin letter each looks like, by the public table of confusables.

    The table holds one shape for ``I`` and ``l``; a capital of it is taken for ``I``.
    """
    if not _ALIKE:
        letters = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if ud.category(c) in ("Lu", "Ll") and "LATIN" not in ud.name(c, "LATIN") and not ud.name(c).startswith("MATHEMATICAL") and not ud.decomposition(c)]
        skeletons = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
        for c, k in zip(letters, skeletons, strict=True):
            if len(k) == 1 and k.isascii() and k.isalpha():
                _ALIKE[c] = "I" if k == "l" and ud.category(c) == "Lu" else k
    return _ALIKE


def mappings(spark: SparkSession) -> tuple[dict[str, tuple[str, str, bool]], dict[str, int], set[str], set[str]]:
    """Of changing characters: decomposed form, composed form, and whether they change in any text; classes of combining
    marks; characters that may compose with, or move before, the ones before them; invisible characters."""
    return _mappings(tuple(sorted(look_alikes(spark).items())))


@lru_cache(maxsize=2)
def _mappings(letters: tuple[tuple[str, str], ...]) -> tuple[dict[str, tuple[str, str, bool]], dict[str, int], set[str], set[str]]:
    alike = dict(letters) | dict.fromkeys(HYPHENS, "-")
    hidden = set(INVISIBLE) | {chr(c) for c in range(0xFE00, 0xFE10)} | {chr(c) for c in range(0xE0100, 0xE01F0)}
    change: dict[str, tuple[str, str, bool]] = {}
    classes: dict[str, int] = {}
    moving = {chr(c) for c in range(0x1160, 0x1200)}
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        if (k := ud.combining(c)) and c not in hidden:
            classes[c] = k
        if c in hidden:
            change[c] = ("", "", True)
            continue
        parts = ud.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            moving.add(chr(int(parts[1], 16)))
        if 0xAC00 <= code < 0xD7A4:
            change[c] = (ud.normalize("NFD", c), c, False)
            continue
        full = _decompose(c)
        low = ud.normalize("NFD", "".join(alike.get(x, x) for x in ud.normalize("NFD", full) if x not in hidden))
        high = ud.normalize("NFC", low)
        if low != c:
            change[c] = (low, high, high != c)
        if high != c and any(ud.combining(x) for x in high):
            moving.add(c)
    return change, classes, moving, hidden


def char_class(chars) -> str:
    """A Java character class that holds ``chars``."""
    codes = sorted(ord(c) for c in chars)
    parts, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        parts.append(f"\\x{{{codes[i]:x}}}" + (f"-\\x{{{codes[j]:x}}}" if j > i else ""))
        i = j + 1
    return "[" + "".join(parts) + "]"


#: Ranges of the classes that only tell which texts to take apart; a wider class costs work, never a result.
RANGES = 40


def coarse_class(chars, ranges: int = RANGES) -> str:
    """A class that holds ``chars``: the smallest gaps between them are filled until so few ranges are left that a match is quick."""
    codes = sorted(map(ord, chars))
    gaps = sorted(((b - a, a) for a, b in zip(codes, codes[1:]) if b - a > 1), reverse=True)
    keep = {a for _, a in gaps[: ranges - 1]}
    parts, begin = [], codes[0]
    for a, b in zip(codes, [*codes[1:], None]):
        if b is None or a in keep:
            parts.append(f"\\x{{{begin:x}}}-\\x{{{a:x}}}")
            begin = b
    return "[" + "".join(parts) + "]"


#: No character of these ranges changes; they are told first, since most text is made of them.
_PLAIN = r"[^\x{9}-\x{9f}\x{4e00}-\x{9fff}]"


def _patterns(spark: SparkSession) -> tuple[str, str, str, str]:
    """Classes of: characters that change in any text, marks that may compose or move, marks of any class, invisible ones."""
    change, classes, moving, hidden = mappings(spark)
    of = lambda chars, n: f"[{_PLAIN}&&{coarse_class(chars, n)}]"
    return of((c for c, m in change.items() if m[2]), RANGES), of(moving, 3 * RANGES), of(classes, 3 * RANGES), of(hidden, RANGES)


def fingerprint(c: str | Column) -> Column:
    """128 bits of a text, as two numbers."""
    c = F.col(c) if isinstance(c, str) else c
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit("form"), c).alias("b"))


def _flagged(spark: SparkSession, texts: DataFrame, column: str) -> DataFrame:
    """``k`` (128 bits of it), ``text``, ``marks`` and ``moves`` of every distinct non-null text: whether it is taken apart."""
    any_change, moving, mark, hidden = _patterns(spark)
    text = texts.where(F.col(column).isNotNull()).select(F.col(column).alias("text")).distinct()
    t = F.col("text")
    marks = t.rlike(f"{moving}|{mark}{{2}}") | (t.rlike(hidden) & t.rlike(mark))
    return text.select(fingerprint("text").alias("k"), "text", marks.alias("marks"), t.rlike(any_change).alias("moves"))


def _composed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"g": b["g"], "n": [ud.normalize("NFC", o) for o in b["o"]]})


def _changed(spark: SparkSession, moving: DataFrame) -> DataFrame:
    """``k``, ``text``, ``form`` of the texts that are taken apart."""
    change, classes, composing, _ = mappings(spark)
    known = spark.createDataFrame([(c, low, high, always) for c, (low, high, always) in change.items()], "ch string, low string, high string, always boolean")

    # positioned code points, the changing ones with their replacement
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(SEGMENT))
    segments = moving.select("k", "text", "marks", F.explode(starts).alias("s")).select("k", "marks", "s", F.expr(f"substring(text, s + 1, {SEGMENT})").alias("seg"))
    points = segments.select("k", "marks", "s", F.posexplode(F.regexp_extract_all("seg", F.lit("(?s)."), F.lit(0))).alias("i", "ch"))
    edits = points.join(F.broadcast(known), "ch").where("marks or always").select("k", "s", F.struct("i", F.when(F.col("marks"), F.col("low")).otherwise(F.col("high")).alias("r")).alias("e"))
    per_segment = edits.groupBy("k", "s").agg(F.array_sort(F.collect_list("e")).alias("es"))
    # rebuild: the stretch before each edit, its replacement, and the rest
    seg = F.col("seg")
    stretch = F.expr("transform(es, (e, j) -> concat(substring(seg, if(j = 0, 0, es[j - 1].i + 1) + 1, e.i - if(j = 0, 0, es[j - 1].i + 1)), e.r))")
    rest = F.expr("substring(seg, element_at(es, -1).i + 2)")
    rebuilt = segments.join(per_segment, ["k", "s"], "left").select("k", "s", F.when(F.col("es").isNull(), seg).otherwise(F.concat(F.array_join(stretch, ""), rest)).alias("r"))
    whole = rebuilt.groupBy("k").agg(F.expr("array_join(transform(array_sort(collect_list(struct(s, r))), x -> x.r), '')").alias("form"))
    plain = cut(moving.join(whole, "k").select("k", "text", "marks", "form"))

    # texts with marks: order the marks after each base by class, then compose
    mark = char_class(set(classes) | composing)
    cluster = f"(?s)[^{mark[1:-1]}]?{mark}+"
    marked = plain.where("marks")
    parts = cut(marked.select("k", F.split("form", cluster, -1).alias("p"), F.regexp_extract_all("form", F.lit(cluster), F.lit(0)).alias("gs")))
    groups = parts.select(F.explode(F.array_distinct("gs")).alias("g")).distinct()
    ranks = spark.createDataFrame([(c, r) for c, r in classes.items()], "ch string, ccc int")
    letters = groups.select("g", F.posexplode(F.regexp_extract_all("g", F.lit("(?s)."), F.lit(0))).alias("i", "ch")).join(F.broadcast(ranks), "ch", "left")
    # a mark moves over marks only: what stands between two characters without class is ordered within itself
    run = F.sum(F.when(F.col("ccc").isNull(), 1).otherwise(0)).over(Window.partitionBy("g").orderBy("i"))
    ordered = letters.select("g", "i", "ch", F.coalesce("ccc", F.lit(0)).alias("ccc"), run.alias("run")).groupBy("g").agg(F.expr("array_join(transform(array_sort(collect_list(struct(run, ccc, i, ch))), x -> x.ch), '')").alias("o"))
    better = ordered.mapInPandas(_composed, "g string, n string")
    changed = parts.select("k", F.posexplode("gs").alias("i", "g")).join(better, "g").groupBy("k").agg(F.expr("transform(array_sort(collect_list(struct(i, n))), x -> x.n)").alias("ns"))
    joined = parts.join(changed, "k", "left").select("k", F.expr("array_join(zip_with(p, coalesce(ns, array()), (x, y) -> concat(x, coalesce(y, ''))), '')").alias("form"))
    return plain.where("not marks").select("k", "text", "form").unionByName(marked.select("k", "text").join(joined, "k").select("k", "text", "form"))


def forms(texts: DataFrame, column: str) -> DataFrame:
    """``column`` and ``form`` of every distinct non-null text."""
    spark = texts.sparkSession
    flagged = cut(_flagged(spark, texts, column))
    still = flagged.where("not marks and not moves").select("text", F.col("text").alias("form"))
    return still.unionByName(_changed(spark, flagged.where("marks or moves")).select("text", "form")).withColumnRenamed("text", column)


def alike_groups(df: DataFrame, key: str, column: str) -> DataFrame:
    """``f`` (of the form), ``t`` (of the text), ``key``: the rows of every form that unlike texts share, each row once.

    The answer in the size of the data: copies and unlike texts of one form are not paired.
    """
    spark = df.sparkSession
    rows = df.where(F.col(key).isNotNull() & F.col(column).isNotNull() & (F.col(column) != "")).select(F.col(key).alias("key"), F.col(column).alias("text"))
    flagged = cut(_flagged(spark, rows, "text"))
    moved = _changed(spark, flagged.where("marks or moves")).where("form <> ''").select(F.col("k").alias("t"), fingerprint("form").alias("f"))
    form = cut(flagged.where("not marks and not moves").select(F.col("k").alias("t"), F.col("k").alias("f")).unionByName(moved))
    several = form.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f")
    variants = form.join(several, "f", "left_semi")
    return cut(rows.select("key", fingerprint("text").alias("t")).distinct().join(variants, "t").select("f", "t", "key"))


def alike_pairs(df: DataFrame, key: str, column: str) -> DataFrame:
    """``key_a``, ``key_b`` (``key_a`` < ``key_b``): rows whose texts differ and have the same form, from ``alike_groups``.

    Texts are paired first and then expanded to their rows, so copies of one text meet each other nowhere.
    """
    groups = alike_groups(df, key, column)
    texts = groups.select("f", "t").distinct()
    twins = texts.select("f", F.col("t").alias("ta")).join(texts.select("f", F.col("t").alias("tb")), "f").where("ta <> tb").select("ta", "tb")
    a, b = groups.select(F.col("key").alias("key_a"), F.col("t").alias("ta")), groups.select(F.col("key").alias("key_b"), F.col("t").alias("tb"))
    return twins.join(a, "ta").join(b, "tb").where("key_a < key_b").select("key_a", "key_b").distinct()
