"""Texts cut off by a field limit or in transfer.

A backward character n-gram model is trained on the whole corpus, by language and by whether a text uses sentence marks:
for the context of the last n characters before a place it counts how often a unit of text ends there (at a line, a
paragraph or the text's end) and how often it goes on. A value is cut off when, for the longest of its final contexts that
the corpus knows, going on is likelier than ending by the log-odds threshold of its language and column.

Numbers count as one digit and capitals as one capital, so that parts of codes are like each other. A text's own end is no
evidence for itself, and copies of a text count once. Null and blank texts are no cases. Script, language and marks of a
text are decided by the whole of it.

Contexts of up to 5 characters are counted for every place; longer ones only for places whose last ``ANCHOR`` characters
may end some text, which a Bloom filter tells. Its size follows the number of texts up to ``MOST_BITS``; a fuller filter
lets more rows through and never changes a count.

The threshold of a language is fitted to the column: of the log-odds near 0 the one that the fewest of its texts are near,
so that it lies in the valley between complete and cut texts; of equals the one nearest 0. ``THRESHOLDS`` overrides it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.sentences import NEVER_END
from lodestrand.session import cut

#: Lengths of the contexts, the longest last; contexts from ANCHOR on are filtered, and from OWN on the ends of other texts
#: count as evidence (a shorter context would be taught by the cut ends themselves). One more context is the whole last line.
LENGTHS = (1, 2, 3, 5, 8, 12, 18, 28)
ANCHOR, OWN, LINE = 8, 12, 64
# A text's last line is a context as a whole, however long it is; ``LINE`` is the length it is reported with.
#: Ends of so many other texts count for the contexts from OWN_SHORT on that are shorter than OWN.
OWN_SHORT, OWN_LEAST = 5, 3
#: Bits of the Bloom filter an entry, at least and at most so many (powers of two), and hashes of an entry.
ENTRY_BITS, LEAST_BITS, MOST_BITS, BLOOM_HASHES = 16, 1 << 20, 1 << 28, 2
#: Log-odds a text must reach to count as complete, by (column, language), where the fitted ones are not wanted.
THRESHOLDS: dict[tuple[str, str], float] = {}
#: A threshold is one of the middles of bins this wide, no farther from 0 than REACH.
BIN, REACH = 0.25, 1.0
SMOOTH = 0.25

_WIDE = "⺀-〿぀-ヿ㐀-鿿豈-﫿！-～"
_WRAP_WIDE = re.compile(rf"(?<=[{_WIDE}，、；：（A-Za-z0-9])(?<![。！？”」])[^\S\n]*(?<!\n)\n(?!\n)(?![^\S\n]*(?:[-•*(（①-⑳]|\d{{1,3}}[.)、]))(?=[{_WIDE}])")
_WRAP = re.compile(r"(?<=[^\s.!?。！？।…”\"»」:：])[^\S\n]*(?<!\n)\n(?!\n)(?![^\S\n]*(?:[-•*(（①-⑳]|\d{1,3}[.)][^\S\n]))")
_WIDE_TEXT = re.compile(rf"[{_WIDE}]+")
_MARKED = re.compile(r"[。！？।!?]|\.(?=\s|\Z)")
_WIDE_MARKED = re.compile(r"[。！？]")
_THAI = re.compile(r"[฀-๿]+")
_LOOSE = re.compile(r"(?<=[฀-๿⺀-鿿）”])[ 　]+(?=[฀-๿⺀-鿿（“0-9])|(?<=[0-9])[ 　]+(?=[฀-๿])")


# Frequent words that tell Latin-script languages apart where none is given.
FREQUENT = {"en": "the of and was to in from at", "de": "der die das und war wie nicht ohne", "fr": "le la les est une des dans pas"}


def language(c: str = "lang"):
    """The first two letters of a language in lower case; empty where it is missing."""
    return F.lower(F.substring(F.trim(F.coalesce(F.col(c), F.lit(""))), 1, 2))


def guess(text: str) -> str:
    """A language for a text without one, by script and frequent words."""
    for pattern, g in ((r"[฀-๿]+", "th"), (r"[ऀ-ॣ]+", "hi"), (r"[぀-ヿ]+", "ja"), (r"[一-鿿]+", "zh")):
        if sum(map(len, re.findall(pattern, text))) * 8 > len(text):
            return g
    words = re.findall(r"[a-zà-ÿ]+", text.lower())
    counts = {g: sum(w in set(f.split()) for w in words) for g, f in FREQUENT.items()}
    return max(counts, key=lambda g: counts[g]) if any(counts.values()) else ""


# What a cut leaves behind a text: marks of omission, and pieces of a character, an entity, a tag or an escape.
REMAINS = re.compile(r"(?:\s*(?:\[(?:more|cut|truncated|\.\.\.|…)\]|\((?:more|cut|truncated)\)|…+|\.{3,})|\ufffd+|&#?[0-9A-Za-z]{0,7}|<[/A-Za-z]{0,6}|\\u?[0-9a-fA-F]{0,3})\Z")


_ONE_CAPITAL = str.maketrans("BCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 25)


def plain(text: str) -> tuple[str, bool]:
    """``text`` without the line breaks of its layout, numbers and capitals as one, and whether it uses sentence marks."""
    t = text.replace("\r\n", "\n").strip()
    t = REMAINS.sub("", t).rstrip() or t
    t = re.sub(r"\d+", "9", t)
    t = re.sub(r"[B-Z]", "A", t)
    thai = sum(map(len, _THAI.findall(t))) * 10 > len(t)
    wide = not thai and sum(map(len, _WIDE_TEXT.findall(t))) * 3 > len(t)
    marked = not thai and bool((_WIDE_MARKED if wide else _MARKED).search(t))
    if marked:
        t = _WRAP_WIDE.sub("", t) if wide else _WRAP.sub(" ", t)
    else:
        t = _LOOSE.sub("\n", t)
    t = re.sub(r"[^\S\n]*\n\s*", "\n", t)
    return re.sub(r"[^\S\n]+", " ", t), marked


def _lay(bodies: list[str], seeds: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all plain texts with gaps of zeros between, the place of each text's last character and each place's seed."""
    gap = LENGTHS[-1]
    joined = "\0" * gap + ("\0" * gap).join(bodies) + "\0" * gap
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) + gap
    last = np.cumsum(sizes) - 1
    return cp, last, np.concatenate([np.repeat(np.array(seeds, np.uint64), sizes), np.zeros(gap, np.uint64)])


def _labels(cp: np.ndarray, last: np.ndarray, bodies: list[str], marks: list[bool]) -> np.ndarray:
    """Each place's label: 1 a unit ends there, 0 it goes on, -1 it is no evidence; a text's own end is none."""
    total = len(cp)
    sizes = np.diff(np.concatenate([[-1], last]))
    spread = lambda x: np.concatenate([np.repeat(np.array(x, bool), sizes), np.zeros(total - int(sizes.sum()), bool)])
    marked, low_quote, short = spread(marks), spread(["„" in t for t in bodies]), np.zeros(total, bool)
    for t, e in zip(bodies, last):
        for x in _ABBREVIATION.finditer(t):
            short[e - len(t) + x.end()] = True
    nxt, nxt2 = np.concatenate([cp[1:], [0]]), np.concatenate([cp[2:], [0, 0]])
    brk = (cp == 10) | (cp == 0)
    # inside a quotation: opened more often than closed since the line began
    high = cp == 0x201C
    opens = np.isin(cp, _OPEN) | (high & ~low_quote)
    closes = np.isin(cp, _CLOSE) | (high & low_quote)
    straight = np.cumsum(cp == 34)
    depth = np.cumsum(opens.astype(np.int64) - closes)
    begin = np.maximum.accumulate(np.where(brk, np.arange(total), 0))
    quoted = (depth - depth[begin] > 0) | ((straight - straight[begin]) % 2 == 1)
    label = np.zeros(total, np.int8)
    label[brk] = -1
    label[~brk & ((nxt == 10) | (nxt == 0))] = 1
    within = ~brk & (nxt != 10) & (nxt != 0) & marked
    stop = within & np.isin(cp, _STOP) & ~quoted & ~short
    begins = np.isin(nxt2, _BEGIN)
    label[stop & (nxt == 32) & begins] = 1
    label[stop & (nxt == 32) & ~begins & (nxt2 >= 0x900)] = 1
    label[stop & np.isin(nxt, _BEGIN) & ~np.isin(nxt, _DIGIT)] = -1
    label[within & np.isin(cp, _WIDE_STOP) & ~quoted & ~np.isin(nxt, _CLOSE)] = 1
    label[within & (closes | (cp == 34)) & ~quoted & np.isin(np.concatenate([[0], cp[:-1]]), np.concatenate([_STOP, _WIDE_STOP]))] = -1
    label[last] = -1  # it is counted with the final contexts
    return label


_ABBREVIATION = re.compile(r"(?<![A-Za-zÀ-ÿ9])(?:" + "|".join(sorted({re.escape(w.translate(_ONE_CAPITAL)) for w in NEVER_END if len(w) > 1 or w.islower()}, key=len, reverse=True)) + r"|z\. ?A|d\. ?h|e\.g|i\.e)\.")
_STOP = np.array(list(map(ord, ".!?…")), np.uint32)
_WIDE_STOP = np.array(list(map(ord, "。！？।")), np.uint32)
_OPEN = np.array(list(map(ord, "„«「『")), np.uint32)
_CLOSE = np.array(list(map(ord, "”»」』")), np.uint32)
_DIGIT = np.array([ord("9")], np.uint32)
_BEGIN = np.array([*range(65, 91), *range(0xC0, 0xDF), ord("9"), 34, 0x201C, 0x201E, 0xAB], np.uint32)
_LINE_ENDS = np.concatenate([_STOP, _WIDE_STOP, _CLOSE, [34]]).astype(np.uint32)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Contexts:
    """The hashes of the contexts that end at given places of a batch.

    The hash of a stretch is the difference of two running sums of codes times powers of an odd base, divided by the power
    of its last place, so a context of any length, a whole line too, costs the same.
    """

    def __init__(self, cp: np.ndarray, seed: np.ndarray):
        n = 1 << int(len(cp)).bit_length()
        self.cp, self.seed, self.first = cp, seed, (cp == 10) | (cp == 0)
        code = np.where(self.first, np.uint64(0), _mix(cp.astype(np.uint64) + np.uint64(1)))
        self.total = np.cumsum(code * _powers(_BASE, n)[: len(cp)], dtype=np.uint64)
        self.undo = _powers(_UNBASE, n)

    def last(self, k: int, at: np.ndarray) -> np.ndarray:
        """Of the last ``k`` characters."""
        return _mix((self.total[at] - self.total[at - k]) * self.undo[at] ^ _mix(self.seed[at] + np.uint64(k)))

    def line(self, at: np.ndarray) -> np.ndarray:
        """Of the line so far. One that ends with a mark is the same in any text, another only in texts of its style."""
        style = np.where(np.isin(self.cp[at], _LINE_ENDS), np.uint64(2), self.seed[at] & np.uint64(1))
        breaks = np.flatnonzero(self.first)
        begin = breaks[np.searchsorted(breaks, at, "right") - 1]
        return _mix((self.total[at] - self.total[begin]) * self.undo[at] ^ _mix(style + np.uint64(1000)))


def _seed(lang: str, marked: bool) -> int:
    return sum(ord(c) << (16 * i) for i, c in enumerate(lang[:2])) * 2 + int(marked)


def _bloom_places(h: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([(h >> np.uint64(28 * i)) & np.uint64(bits - 1) for i in range(BLOOM_HASHES)])


#: Index of the line context among a text's final contexts: it is the most telling.
_AT_LINE = len(LENGTHS)


def _finals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The plain form of each text, its seed, whether it uses sentence marks, and the hashes of its final contexts, the line last."""
    for b in _small(batches):
        forms = [plain(t) for t in b.column("text").to_pylist()]
        bodies, marks = [t for t, _ in forms], [m for _, m in forms]
        seeds = [_seed(g or guess(t.as_py()), m) for g, t, m in zip(b.column("lang").to_pylist(), b.column("text"), marks)]
        cp, last, seed = _lay(bodies, seeds)
        at = _Contexts(cp, seed)
        hs = np.stack([*(at.last(k, last) for k in LENGTHS), at.line(last)], axis=1).view(np.int64).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(hs) + 1, len(LENGTHS) + 1), pa.int32()), pa.array(hs))
        yield pa.RecordBatch.from_arrays([b.column("t"), b.column("u"), lists, pa.array(bodies), pa.array(np.array(seeds, np.uint64).view(np.int64)), pa.array(marks)], names=["t", "u", "hs", "text", "seed", "marked"])


def _small(batches: Iterable[pa.RecordBatch], chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``chars`` characters; one longer text is a batch of its own."""
    for b in batches:
        sizes = [len(t) for t in b.column("text").to_pylist()]
        at, n = 0, 0
        for i, s in enumerate(sizes):
            if i > at and n + s > chars:
                yield b.slice(at, i - at)
                at, n = i, 0
            n += s
        if at < len(sizes):
            yield b.slice(at)


def _counter(bloom: np.ndarray):
    def passes(h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for place in _bloom_places(h, 8 * len(bloom)):
            ok &= (bloom[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            bodies = b.column("text").to_pylist()
            cp, last, seed = _lay(bodies, b.column("seed").to_numpy().view(np.uint64))
            label = _labels(cp, last, bodies, b.column("marked").to_pylist())
            at = _Contexts(cp, seed)
            places = np.flatnonzero(label >= 0)
            anchors = at.last(ANCHOR, places)
            near = places[passes(anchors)]
            lines = at.line(places)
            lined = passes(lines)
            parts = [(at.last(k, places if k < ANCHOR else near), places if k < ANCHOR else near) for k in LENGTHS] + [(lines[lined], places[lined])]
            keys, ends, goes = [], [], []
            for h, here in parts:
                k, inverse = np.unique(h, return_inverse=True)
                e = np.bincount(inverse, label[here] == 1, len(k)).astype(np.int64)
                keys.append(k.view(np.int64)), ends.append(e), goes.append(np.bincount(inverse, minlength=len(k)) - e)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ends, goes)], names=["h", "ends", "goes"])

    return run


def _bloom(finals: DataFrame) -> np.ndarray:
    """The filter of the anchors and lines, as bytes that are or-ed before they come to the driver: MOST_BITS / 8 at most."""
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < 2 * ENTRY_BITS * finals.count():
        bits *= 2
    anchor = LENGTHS.index(ANCHOR)

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("hs").flatten().to_numpy().reshape(-1, len(LENGTHS) + 1)[:, [anchor, _AT_LINE]].ravel().astype(np.int64).view(np.uint64)
            at = np.unique(_bloom_places(h, bits).ravel())
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(np.uint64(1) << (at & np.uint64(63))).cast(pa.int64(), safe=False)], names=["w", "bits"])

    words = finals.mapInArrow(places, "w int, bits bigint").groupBy("w").agg(F.bit_or("bits").alias("bits")).toPandas()
    bloom = np.zeros(bits // 64, np.uint64)
    bloom[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return bloom.view(np.uint8)


def thresholds(scored: DataFrame, column: str) -> DataFrame:
    """``lang``, ``threshold`` for every language of ``scored`` (``lang``, ``log_odds``): where the valley near 0 is deepest."""
    steps = int(REACH / BIN)
    counts = scored.where(F.abs("log_odds") <= REACH + BIN).groupBy("lang", F.floor(F.col("log_odds") / BIN + 0.5).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    middles = scored.select("lang").distinct().select("lang", F.explode(F.sequence(F.lit(-steps), F.lit(steps))).alias("bin"))
    near = middles.join(counts, ["lang", "bin"], "left").select("lang", "bin", F.coalesce("n", F.lit(0)).alias("n"))
    best = near.groupBy("lang").agg(F.min(F.struct("n", F.abs("bin").alias("far"), "bin")).alias("x")).select("lang", (F.col("x.bin") * BIN).alias("fitted"))
    fixed = None
    for (c, g), v in THRESHOLDS.items():
        if c == column:
            fixed = F.when(F.col("lang") == g, v) if fixed is None else fixed.when(F.col("lang") == g, v)
    return best.select("lang", (F.coalesce(fixed, "fitted") if fixed is not None else F.col("fitted")).alias("threshold"))


def detect(df: DataFrame, key: str, column: str, lang: str = "lang") -> DataFrame:
    """``key``, ``lang``, ``log_odds`` (of ending against going on), ``known`` (length of the context used), ``threshold``,
    ``cut`` of every text that is not blank; ``key`` must name one row."""
    rows = df.where(F.col(key).isNotNull() & F.col(column).rlike(r"[^\s 　]")).select(F.col(key).alias("key"), language(lang).alias("lang"), F.col(column).alias("text"))
    # a text is named by 128 bits of it and its language
    name = [F.xxhash64("text", "lang").alias("t"), F.xxhash64(F.lit("text"), "lang", "text").alias("u")]
    texts = rows.select("lang", "text").distinct().select(*name, "lang", "text")
    finals = cut(texts.mapInArrow(_finals, "t bigint, u bigint, hs array<bigint>, text string, seed bigint, marked boolean"))
    inner = finals.select("text", "seed", "marked").mapInArrow(_counter(_bloom(finals)), "h bigint, ends bigint, goes bigint")
    wanted = finals.select("t", "u", F.posexplode("hs").alias("i", "h"))
    own = wanted.where(F.col("i") >= LENGTHS.index(OWN_SHORT)).select("h", F.lit(0).cast("bigint").alias("ends"), F.lit(0).cast("bigint").alias("goes"), F.lit(1).cast("bigint").alias("own"))
    counts = inner.withColumn("own", F.lit(0).cast("bigint")).unionByName(own).groupBy("h").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"), F.sum("own").alias("own"))
    others = F.greatest(F.col("own") - 1, F.lit(0))
    others = F.when((F.col("i") >= LENGTHS.index(OWN)) | (others >= OWN_LEAST), others).otherwise(0)
    known = wanted.join(counts, "h").select("t", "u", "i", (F.col("ends") + others).alias("ends"), "goes").where("ends + goes > 0")
    best = known.groupBy("t", "u").agg(F.max(F.struct("i", "ends", "goes")).alias("x"))
    best = best.select("t", "u", F.element_at(F.array(*map(F.lit, (*LENGTHS, LINE))), F.col("x.i") + 1).alias("known"), F.log((F.col("x.ends") + SMOOTH) / (F.col("x.goes") + SMOOTH)).alias("log_odds"))
    scored = cut(rows.select("key", "lang", *name).join(best, ["t", "u"], "left").select("key", "lang", F.coalesce("log_odds", F.lit(-1.0)).alias("log_odds"), F.coalesce("known", F.lit(0)).alias("known")))
    limit = scored.join(thresholds(scored, column), "lang")
    return limit.select(F.col("key").alias(key), "lang", "log_odds", "known", "threshold", (F.col("log_odds") < F.col("threshold")).alias("cut"))
