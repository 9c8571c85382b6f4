"""Free-entered values to the entries of a reference list.

A multi-pattern automaton over all canonical names and aliases finds the mentions embedded in a value; of overlapping
mentions the longest wins, and a mention in a script with spaces begins and ends where a word does. If the longest
mentions that do not overlap mean several entries, the value is ambiguous and names none. Values without a mention go to
token-set similarity against the whole list; of the entries that are near enough the one the value is a slip, a
rearrangement or an abbreviation of is taken, and a tie between two entries is no match. Values compare without case,
width, white space and punctuation, and traditional characters as simplified ones (by the public transliteration of the
ICU library that Spark brings along).

Words and characters that say nothing about the entry (``Company``, ``Ltd``) are taken from the values themselves: those
that occur in at least ``NOISE_SHARE`` of the distinct values and in no entry of the list. They are taken off only where a
value has no mention.

Null, blank and filler values, and values that name no entry, come out with an empty code. The list is collected to the
driver and sent to the workers: ``MAX_ENTRIES`` bounds it, a longer list is an error.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.session import cut, fan_out

MAX_ENTRIES = 200_000
#: Share of the distinct values from which a word or character sequence that no entry holds counts as noise (so a value of
#: n of them bounds them by n / NOISE_SHARE), and share of the entries in a script with spaces from which a word says nothing.
NOISE_SHARE, LIST_SHARE = 0.01, 0.2
#: Longest sequence of CJK characters that may be noise.
NOISE_CHARS = 4

# Values that stand for none.
FILLERS = ["n/a", "na", "none", "null", "unknown", "other", "others", "misc", "tbd", "see attachment", "same as above", "test", "无", "其他", "同上", "待定", "不详", "未知"]

_CJK = re.compile(r"[㐀-鿿豈-﫿]")
_RUN = re.compile(r"[㐀-鿿豈-﫿]+")
_WORD = re.compile(r"[^\W_]+")
_CODE = re.compile(r"(?<![a-z0-9])[a-z]\d{3,4}(?![a-z0-9])|(?<![a-z0-9])[a-z]\d{4}(?=[^\x00-\x7f])")


def simplified(spark: SparkSession) -> dict[int, str]:
    """Traditional characters and the simplified ones they are written with, by the public transliteration."""
    blocks = [chr(c) for r in ((0x3400, 0xA000), (0xF900, 0xFB00)) for c in range(*r)]
    turned = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified").transliterate("\n".join(blocks)).split("\n")
    return {ord(a): b for a, b in zip(blocks, turned, strict=True) if a != b}


def radicals(spark: SparkSession) -> dict[str, int]:
    """The radical of each CJK character, by the public order of characters by radical and strokes."""
    jvm = spark.sparkContext._jvm
    roots = [unicodedata.normalize("NFKC", chr(c)) for c in range(0x2F00, 0x2FD6)]
    order = jvm.java.util.Collections.list(jvm.java.util.StringTokenizer("\n".join(map(chr, range(0x4E00, 0xA000)))))
    jvm.java.util.Collections.sort(order, jvm.com.ibm.icu.text.Collator.getInstance(jvm.com.ibm.icu.util.ULocale("zh-u-co-unihan")))
    at, out = -1, {}
    number = {c: i for i, c in enumerate(roots)}
    for c in jvm.java.lang.String.join("\n", order).split("\n"):
        at = number.get(c, at)
        out[c] = at
    return out


def fold(value: str, simple: dict[int, str]) -> str:
    """``value`` in one width, case and script form, with separators as single spaces."""
    v = unicodedata.normalize("NFKC", value).casefold().translate(simple)
    v = re.sub(r"[&+]+", " and ", v)
    return v.strip()


def squeeze(folded: str) -> str:
    """Letters and digits only."""
    return "".join(_WORD.findall(folded))


def edits(a: str, b: str, limit: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between ``a`` and ``b``; over ``limit``: ``limit`` + 1."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row[j] = d
        if min(row) > limit:
            return limit + 1
        before, last = last, row
    return last[-1]


def _shortens(short: str, word: str) -> bool:
    if not short or short[0] != word[0] or len(short) < 3 or len(short) > len(word):
        return short == word
    it = iter(word)
    return all(c in it for c in short)


def parts_of(folded: str) -> set[str]:
    """What may be noise in a value: its words, and the sequences of up to ``NOISE_CHARS`` CJK characters."""
    out = {w for w in _WORD.findall(_CODE.sub(" ", folded)) if not _CJK.search(w)}
    for r in _RUN.findall(folded):
        out |= {r[i : i + n] for n in range(1, NOISE_CHARS + 1) for i in range(len(r) - n + 1)}
    return out


def _limit(spelling: str) -> int:
    """Edits a value may be away from a spelling."""
    return (1 if len(spelling) <= 8 else 2) if _CJK.search(spelling) else min(3, len(spelling) // 6)


class Matcher:
    """The reference list, ready to look values up in."""

    def __init__(self, entries: list[tuple[str, str]], noise: Iterable[str] = (), simple: dict[int, str] | None = None, radical: dict[str, int] | None = None):
        """``entries``: pairs of a name or alias and its code. A name that several codes share names none of them."""
        import ahocorasick

        self.simple, self.radical = simple or {}, radical or {}
        codes: dict[str, set[str]] = defaultdict(set)
        text: dict[str, str] = {}
        for name, code in entries:
            f = fold(name, self.simple)
            if k := squeeze(f):
                codes[k].add(code)
                text.setdefault(k, f)
        held: dict[str, int] = defaultdict(int)
        for f in text.values():
            for w in parts_of(f):
                held[w] += 1
        spaced = sum(not _CJK.search(f) for f in text.values())
        common = {w for w, n in held.items() if n > max(LIST_SHARE * spaced, 1 / LIST_SHARE) and not _CJK.search(w)}
        noise = {x for x in noise if x not in held}
        self.noise_words = {x for x in noise if not _CJK.search(x)} | common
        cjk = sorted((x for x in noise if _CJK.search(x)), key=lambda x: (-len(x), x))
        self.noise = re.compile("|".join(map(re.escape, cjk))) if cjk else None
        self.keys = [k for k in codes if len(codes[k]) == 1]
        self.codes = [next(iter(codes[k])) for k in self.keys]
        self.words = [self._words(text[k]) for k in self.keys]
        self.auto = ahocorasick.Automaton()
        for i, k in enumerate(self.keys):
            self.auto.add_word(k, i)
        if self.keys:
            self.auto.make_automaton()
        # spellings: an entry as written and without noise; by token, and by a word's place and first letter
        self.spelled = sorted({(x, i) for i, k in enumerate(self.keys) for x in (k, "".join(self.words[i])) if x})
        self.posting: dict[str, list[int]] = defaultdict(list)
        self.least: list[int] = []
        for j, (x, _) in enumerate(self.spelled):
            t = self._tokens(x)
            # an edit changes one character token, or at most three tokens of neighbours (a swap)
            self.least.append(len(t) - _limit(x) * (1 if _CJK.search(x) else 3))
            for y in t:
                self.posting[y].append(j)
        self.initial: dict[tuple[int, int, str], list[int]] = defaultdict(list)
        for i, ws in enumerate(self.words):
            for n, w in enumerate(ws):
                self.initial[len(ws), n, w[0]].append(i)

    def _words(self, folded: str) -> list[str]:
        bare = _CODE.sub(" ", folded)
        words = _WORD.findall(bare)
        return words if _CJK.search(bare) else [w for w in words if w not in self.noise_words]

    @staticmethod
    def _tokens(key: str) -> set[str]:
        """Token set: single characters of CJK text, pairs of neighbours of other text."""
        if _CJK.search(key):
            return set(key)
        return {key[i : i + 2] for i in range(len(key) - 1)} or {key}

    def mentioned(self, folded: str) -> set[str]:
        """The codes of the longest mentions that do not overlap; one in a script with spaces begins and ends as words do."""
        if not self.keys:
            return set()
        at = [i for i, c in enumerate(folded) if c.isalnum()]
        squeezed = "".join(folded[i] for i in at)
        word = lambda i: 0 <= i < len(folded) and folded[i].isalnum() and not _CJK.match(folded[i])
        spans = []
        for end, i in self.auto.iter(squeezed):
            first = end - len(self.keys[i]) + 1
            a, b = at[first], at[end]
            if not (word(a) and word(a - 1)) and not (word(b) and word(b + 1)):
                spans.append((-len(self.keys[i]), first, end, i))
        taken: list[tuple[int, int]] = []
        out = set()
        for _, first, end, i in sorted(spans):
            if all(end < a or first > b for a, b in taken):
                taken.append((first, end))
                out.add(self.codes[i])
        return out

    def _orders(self, folded: str) -> list[list[str]]:
        """The value's words as written, and with its parts exchanged at a comma, a bracket or ``of``."""
        bare = _CODE.sub(" ", folded)
        out = [self._words(bare)]
        for parts in (re.split(r"\s*,\s*|\s+of\s+", bare), re.split(r"[()]+", bare)):
            parts = [p for p in parts if self._bare(p)]
            if len(parts) == 2:
                first = self._words(parts[1])
                if " of " in f" {bare} " and first and first[-1].endswith("s"):
                    first = [*first[:-1], first[-1][:-1]]
                out.append(first + self._words(parts[0]))
        return [o for o in out if o]

    def _bare(self, folded: str) -> str:
        words = "".join(self._words(folded))
        return self.noise.sub("", words) if self.noise else words

    def similar(self, folded: str) -> set[str]:
        """The codes of the entries the value is nearest to, of those that are near enough."""
        best: dict[str, int] = {}

        def found(i: int, d: int) -> None:
            best[self.codes[i]] = min(d, best.get(self.codes[i], d))

        for words in self._orders(folded):
            key = "".join(words)
            forms = {key}
            if len(words) > 1 and not _CJK.search(key):
                forms.add(squeeze(_CODE.sub(" ", folded)))
            if self.noise and _CJK.search(key):
                forms |= {self.noise.sub("", key)} - {""}
            for form in forms:
                hits: dict[int, int] = defaultdict(int)
                for t in self._tokens(form):
                    for j in self.posting.get(t, ()):
                        hits[j] += 1
                for j, n in hits.items():
                    x, i = self.spelled[j]
                    if n >= self.least[j] and (d := edits(form, x, _limit(x))) <= _limit(x):
                        found(i, 5 if d == 1 and self._same_radical(form, x) else d * 10)
            if not _CJK.search(key):
                for i in {i for n, w in enumerate(words) for i in self.initial.get((len(words), n, w[0]), ())}:
                    if all(_shortens(a, b) or edits(a, b, 1) <= 1 for a, b in zip(words, self.words[i])):
                        found(i, 15)
        low = min(best.values(), default=0)
        return {c for c, d in best.items() if d == low}

    def _same_radical(self, a: str, b: str) -> bool:
        """Whether the one character two spellings differ in has the same radical in both: a slip of the shape."""
        if len(a) != len(b):
            return False
        x, y = next((x, y) for x, y in zip(a, b) if x != y)
        return self.radical.get(x, -1) == self.radical.get(y, -2)

    def decide(self, value: str | None) -> tuple[str, str]:
        """The code ``value`` means, or an empty text, and why: ``mention``, ``similar``, ``ambiguous``, ``filler`` or ``none``."""
        folded = fold(value, self.simple) if value is not None else ""
        if not squeeze(folded) or folded.strip(" .。?") in FILLERS:
            return "", "filler"
        codes, why = self.mentioned(folded), "mention"
        if not codes:
            codes, why = self.similar(folded), "similar"
        if len(codes) > 1:
            return "", "ambiguous"
        return (codes.pop(), why) if codes else ("", "none")


@lru_cache(maxsize=1)
def _of_worker(entries: tuple, noise: tuple, simple: tuple, radical: tuple) -> Matcher:
    """The list is made ready once a worker process, not once a task."""
    return Matcher(list(entries), noise, dict(simple), dict(radical))


def noise_of(values: DataFrame, column: str, simple: dict[int, str]) -> list[str]:
    """Words and character sequences that at least ``NOISE_SHARE`` of the distinct ``values`` hold."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"part": [p for v in b[column] for p in parts_of(fold(v, simple))]}, dtype=str)

    least = max(values.count() * NOISE_SHARE, 2)
    return sorted(r["part"] for r in values.mapInPandas(run, "part string").groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect())


def decide_values(df: DataFrame, key: str, column: str, entries: list[tuple[str, str]]) -> DataFrame:
    """``key``, ``value``, ``full_code`` and ``why`` of each row; every distinct value is looked up once.

    A key counts once however often its row is repeated; rows of one key with different values give a row each.
    """
    if len(entries) > MAX_ENTRIES:
        raise ValueError(f"the reference list has {len(entries)} names, more than {MAX_ENTRIES}")
    spark = df.sparkSession
    simple = simplified(spark)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key), F.col(column).alias("value")).dropDuplicates()
    distinct = cut(fan_out(rows.select("value").where("value is not null").distinct()))
    known = spark.sparkContext.broadcast((tuple(entries), tuple(noise_of(distinct, "value", simple)), tuple(simple.items()), tuple(radicals(spark).items())))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = _of_worker(*known.value)
        for b in batches:
            codes = [matcher.decide(v) for v in b["value"]]
            yield pd.DataFrame({"value": b["value"], "full_code": [c for c, _ in codes], "why": [w for _, w in codes]})

    found = distinct.mapInPandas(run, "value string, full_code string, why string")
    return rows.join(found, "value", "left").select(key, "value", F.coalesce("full_code", F.lit("")).alias("full_code"), F.coalesce("why", F.lit("filler")).alias("why"))


def map_values(df: DataFrame, key: str, column: str, entries: list[tuple[str, str]]) -> DataFrame:
    """``key`` and ``full_code`` of each row."""
    return decide_values(df, key, column, entries).select(key, "full_code")
