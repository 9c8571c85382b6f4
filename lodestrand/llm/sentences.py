"""Sentences of texts in many languages.

The rules are compiled into a finite transducer over character classes: its state knows whether a quotation is open and
how it began, what ended just now, and whether a colon or comma stands before; its output says before which characters a
sentence begins. A text is turned into events (characters that can move a state, in order), the events are cut into
segments of ``SEGMENT``, and every segment of a text of several is a function from entering to leaving state. The
functions are composed by a prefix scan that doubles its reach each round, and every segment is then read from the state
it is entered in. Where the cuts lie changes no row: an event is the same whatever segment it falls into.

What a class depends on (the paragraph's script, list markers, the first quotation mark) is worked out with the events,
in passes over whole batches of code points, so a text costs no Python step a character.

A heading, a list item with its marker and a run of data in a paragraph of their own are one sentence each. Line breaks and
spaces end a sentence only in texts whose script there has no sentence marks. Offsets count characters from 0, ends are
exclusive; null and blank texts have no sentences.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.session import cut

#: Events of a segment (a sentence has about five); a parameter of speed only.
SEGMENT = 64

# Abbreviations that stand before what they belong to, and such as may end a sentence.
NEVER_END = "No Nos Nr Fig Figs Sec Sect Abb Tab Kap vgl Vgl ca approx Approx ref Ref réf Réf env cf Cf p pp vs Dr Mr Mrs Ms Prof St Art art Bd bzw resp chap vol Vol Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec janv févr avr juil déc Az Ziff Abs incl max Hr Fr Mme M".split()
MAY_END = "etc usw Ltd Inc Co Corp f ff Min Std al sq".split()
PAIRS_NEVER = r"z\.\s?B\.|d\.\s?h\.|u\.\s?a\.|e\.\s?g\.|i\.\s?e\.|E\.\s?g\.|I\.\s?e\.|c\.-à-d\."
PAIRS_MAY = r"a\.\s?m\.|p\.\s?m\.|A\.M\.|P\.M\.|u\.s\.w\."
GERMAN_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jänner"
# Words that carry a sentence on after a quotation.
CARRY_ON = ["随后", "然后", "接着", "并", "便", "就", "而后", "と", "って", "और", "तथा", "फिर"]

# Character classes.
CLASSES = ["space", "line", "para", "gap", "lower", "upper", "other", "carry", "number", "hard", "dot", "maydot", "ellipsis", "open", "close", "toggle", "intro", "punct", "marker", "odd"]
CLASS = {c: i for i, c in enumerate(CLASSES)}
# State: quotation (none, said, other), whether its last token ended a sentence, what ended, whether a colon or comma stands before.
QUOTES, ENDED = ("none", "said", "plain"), ("start", "none", "dot", "hard", "maydot", "ellipsis", "saidquote", "quote")


def _step(state: tuple, c: str) -> tuple[tuple, bool]:
    """The next state and whether a sentence begins before a character of class ``c``."""
    q, t, p, f = state
    if c == "space" or c == "line":
        return state, False
    if c in ("para", "gap"):
        return ("none", 0, "start", 0), False
    if c == "marker":
        return ("none", 0, "none", 0), True
    first = p == "start"
    if q != "none":  # inside a quotation nothing ends
        if c in ("hard", "dot", "ellipsis", "maydot"):
            return (q, 1, "none", 0), first
        if c == "close" or c == "toggle":
            return ("none", 0, ("saidquote" if q == "said" else "quote") if t else "none", 0), first
        return (q, 0 if c not in ("punct", "odd") else t, "none", 0), first
    starts = first or {
        "hard": c in ("upper", "other", "carry", "number", "open", "toggle", "odd"),
        "dot": c in ("upper", "other", "carry", "number", "open", "toggle"),
        "maydot": c in ("upper", "number", "open", "toggle"),
        "ellipsis": c == "upper",
        "saidquote": c in ("upper", "other", "number", "open", "toggle"),
        "quote": c in ("upper", "open", "toggle"),
        "none": False,
    }.get(p, False)
    if c in ("hard", "dot", "ellipsis"):
        return ("none", 0, {"hard": "hard", "dot": "hard" if p == "hard" else "dot", "ellipsis": "ellipsis"}[c], 0), starts
    if c == "maydot":
        return ("none", 0, "maydot", 0), starts
    if c in ("open", "toggle"):
        return ("said" if f else "plain", 0, "none", 0), starts
    if c == "close":  # of a quotation that began before the text, or a bracket
        return ("none", 0, p if not first else "none", 0), starts
    if c == "intro":
        return ("none", 0, "none", 1), starts
    if c == "punct":
        return ("none", 0, "none", 0), starts
    return ("none", 0, "none", 0), starts


def _reachable() -> list[tuple]:
    begin = [("none", 0, "start", 0), ("said", 0, "start", 0)]
    states, todo = list(begin), list(begin)
    while todo:
        s = todo.pop()
        for c in CLASSES:
            n = _step(s, c)[0]
            if n not in states:
                states.append(n)
                todo.append(n)
    return states


#: States that can be reached from the two a text may begin in, which come first.
STATES = _reachable()
STATE = {s: i for i, s in enumerate(STATES)}
BEGIN, IN_QUOTE = 0, 1
assert set(STATES) <= set(product(QUOTES, (0, 1), ENDED, (0, 1)))


@lru_cache(maxsize=1)
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """Tables of next states and outputs by state and class."""
    to = np.array([[STATE[_step(s, c)[0]] for c in CLASSES] for s in STATES], np.int8)
    out = np.array([[_step(s, c)[1] for c in CLASSES] for s in STATES], bool)
    return to, out


# --- classes of characters

_MARK = r"[-•*–·▪●○](?=[^\S\n])|[(（]\d{1,3}[)）]|\d{1,3}[)）]|[①-⑳]|[(（][一二三四五六七八九十]{1,3}[)）]|[一二三四五六七八九十]{1,3}、"
_NUMBERED = r"\d{1,3}\.(?=[^\S\n])"
_SCRIPTS = ("thai", "cjk", "latin", "indic")
# a text is set between two of these characters; one in a text itself is read as an unknown character
_EDGE = "\0"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: class, script (4 for none) and whether it continues the character before it."""
    import regex

    every = "".join(map(chr, range(0x110000)))
    cls, script, joins = np.full(0x110000, CLASS["odd"], np.uint8), np.full(0x110000, 4, np.uint8), np.zeros(0x110000, bool)

    def put(to: np.ndarray, pattern: str, value) -> None:
        for m in regex.compile(pattern, regex.V1).finditer(every):
            to[m.start() : m.end()] = value

    put(cls, r"[\p{Lo}\p{Lm}\p{M}]+", CLASS["other"])
    put(cls, r"[\p{Lu}\p{Lt}]+", CLASS["upper"])
    put(cls, r"\p{Ll}+", CLASS["lower"])
    put(cls, r"\p{Nd}+", CLASS["number"])
    for chars, c in (("。！？!?।॥؟｡", "hard"), (".", "dot"), ("…⋯", "ellipsis"), ("„«「『‹", "open"), ("”」』»›）)]】》", "close"), ("“\"", "toggle"), (":：", "intro"), (",，、;；،", "punct")):
        cls[[ord(x) for x in chars]] = CLASS[c]
    put(cls, r"\s+", CLASS["space"])
    cls[[0, 0x1C, 0x1D, 0x1E, 0x1F]] = CLASS["space"]
    put(script, r"\p{Thai}+", 0)
    put(script, r"[\p{Han}\p{Hiragana}\p{Katakana}]+", 1)
    put(script, r"[\p{Latin}\p{Cyrillic}\p{Greek}]+", 2)
    put(script, r"\p{Devanagari}+", 3)
    put(joins, r"\p{Mn}+", True)
    joins[[ord("'"), ord("’")]] = True
    return cls, script, joins


@lru_cache(maxsize=1)
def _patterns():
    import regex

    words = lambda ws: "|".join(sorted(map(regex.escape, ws), key=len, reverse=True))
    c = lambda p: regex.compile(p, regex.V1)
    return {
        "marker": c(rf"[^\S\n]*(?:(?P<sure>{_MARK})|(?P<num>{_NUMBERED}))"),
        "markers": c(rf"(?<![^\n\0])[^\S\n]*(?:(?P<sure>{_MARK})|(?P<num>{_NUMBERED}))"),
        "month": c(rf"[^\S\n]*(?:{GERMAN_MONTHS})"),
        "ended": c(r"[。！？!?।.…][”“\"»」』)）]*\s*\Z"),
        "heading": c(r"[^\S\n]*(?:第\s*\d+\s*[节章条部]|\d+(?:\.\d+)*\.?|[(（]?[一二三四五六七八九十]+[)）、.])[^\S\n]+[^\s。，,.]{1,24}[^\S\n]*\Z"),
        # dots of abbreviations: what stands before them is looked at only where there is a dot
        "never": c(rf"\.(?!\.)(?<=(?<![\p{{Latin}}\p{{N}}])(?:{words(NEVER_END)})\.)"),
        "may": c(rf"\.(?!\.)(?<=(?<![\p{{Latin}}\p{{N}}])(?:{words(MAY_END)})\.)"),
        "pair": c(rf"\.(?:(?<=\b(?P<never>{PAIRS_NEVER}))|(?<=\b(?P<may>{PAIRS_MAY})))"),
        "ordinal": c(rf"\.(?=\s+(?:{GERMAN_MONTHS})\b)(?<=(?<!\d)(?<!\d[.,:])\d{{1,2}}\.)"),
        "carry": c(rf"(?<![\p{{Lo}}\p{{Lm}}\p{{M}}])(?:(?:{words(CARRY_ON)})(?=[\p{{L}}\p{{M}}\s])|随(?=\0))"),
    }


def _shift(a: np.ndarray, by: int, fill) -> np.ndarray:
    """``a[i + by]`` at i."""
    out = np.full_like(a, fill)
    if by > 0:
        out[:-by] = a[by:]
    else:
        out[-by:] = a[:by]
    return out


def _last(mask: np.ndarray) -> np.ndarray:
    """At each place the last place up to it where ``mask`` holds, or -1."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1))


class _Layout:
    """Lines, paragraphs, scripts and list markers of a batch of texts."""

    def __init__(self, joined: str, cp: np.ndarray, begin: np.ndarray, blank: np.ndarray, script: np.ndarray):
        pats = _patterns()
        breaks = np.flatnonzero((cp == 10) | (cp == 0))
        self.start = breaks[:-1] + 1  # every line lies between two breaks; the edge of a text is one
        stop = breaks[1:]
        seen = np.concatenate([[0], np.cumsum(~blank)])
        empty = seen[stop] == seen[self.start]
        text_of = np.searchsorted(begin, self.start, "right") - 1
        first = np.isin(self.start, begin)
        self.paragraph = np.cumsum(empty | first)
        # list markers
        kinds = {}
        for m in pats["markers"].finditer(joined):
            at = m.start()
            line = int(np.searchsorted(self.start, at, "right")) - 1
            sure = m.group("sure")
            kinds[line] = (m.start("sure" if sure else "num"), m.end(), bool(sure), not sure and bool(pats["month"].match(joined, m.end())))
        self.markers: dict[int, tuple[int, int]] = {}
        listed = lambda i: i in kinds and (kinds[i][2] or not kinds[i][3])
        for i, (a, b, sure, month) in kinds.items():
            if empty[i]:
                continue
            before = bool(first[i]) or bool(empty[i - 1])
            if sure or (not month and (before or listed(i - 1) or self._next_numbered(kinds, i, first) or self._second(joined, stop, first, i))):
                self.markers[i] = (a, b)
        # scripts of paragraphs, and the scripts of a text that have sentence marks
        size = int(self.paragraph[-1]) + 1 if len(self.paragraph) else 1
        para_of = np.repeat(self.paragraph, stop - self.start + 1)
        body = slice(int(self.start[0]), int(stop[-1]) + 1) if len(stop) else slice(0, 0)
        sc = script[body]
        counts = np.stack([np.bincount(para_of[sc == k], minlength=size) for k in range(4)])
        thai, cjk, latin, _ = counts
        kind = np.where((cjk * 2 >= latin) & (cjk > 0) & (thai == 0), 1, np.argmax(counts, axis=0))
        c = cp
        quote = np.isin(_shift(c, 1, 0), [0x201D, 0x22, 0xBB, 0x29])
        nxt, nxt2 = _shift(blank, 1, True), _shift(blank, 2, True)
        stops = np.isin(c, [0x2E, 0x21, 0x3F]) & (nxt | (quote & nxt2))
        marks = np.isin(c, [ord(x) for x in "。！？।॥؟｡!?"])
        for i, (_, b, _, _) in kinds.items():
            stops[self.start[i] : b] = False
            marks[self.start[i] : b] = False
        has_stop = np.bincount(para_of[stops[body]], minlength=size) > 0
        has_mark = np.bincount(para_of[marks[body]], minlength=size) > 0
        text_of_para = np.zeros(size, np.int64)
        text_of_para[self.paragraph] = text_of
        marked = np.where(kind == 2, has_stop, has_mark) & (kind != 0)
        with_marks = np.zeros((len(begin), 4), bool)
        with_marks[text_of_para[marked], kind[marked]] = True
        self.unmarked = ~with_marks[text_of_para, kind][self.paragraph] if len(self.paragraph) else np.zeros(0, bool)
        # where spaces count: lines of such paragraphs that are no headings, after their markers
        self.loose_from = np.where(self.unmarked, self.start, 1 << 60)
        for i, (_, b) in self.markers.items():
            if self.unmarked[i]:
                self.loose_from[i] = b
        for i in np.flatnonzero(self.unmarked & ~empty):
            if pats["heading"].match(joined[self.start[i] : stop[i]]):
                self.loose_from[i] = 1 << 60

    @staticmethod
    def _next_numbered(kinds: dict, i: int, first: np.ndarray) -> bool:
        return i + 1 in kinds and not first[i + 1] and not kinds[i + 1][2]

    def _second(self, joined: str, stop: np.ndarray, first: np.ndarray, i: int) -> bool:
        """Whether line ``i`` is the second of its text and neither it nor the first ends a sentence."""
        if i == 0 or first[i] or not first[i - 1]:
            return False
        ended = _patterns()["ended"]
        return not ended.search(joined[self.start[i] : stop[i]]) and not ended.search(joined[self.start[i - 1] : stop[i - 1]])


def _wide(c: np.ndarray) -> np.ndarray:
    return ((c >= 0x2E80) & (c <= 0x9FFF)) | ((c >= 0x0E00) & (c <= 0x0E7F)) | np.isin(c, [ord(x) for x in "）”“（」』"])


def lex(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Events of a batch: text, class, place and the end of what is written before it; and of each text the state it is
    entered in and the end of what is written in it."""
    joined = _EDGE + _EDGE.join(t.replace(_EDGE, "�") for t in texts) + _EDGE
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begin = np.cumsum(np.concatenate([[1], sizes[:-1] + 1]))
    by_cp, scripts, joining = _tables()
    pats = _patterns()
    cls = by_cp[cp]
    blank = cls == CLASS["space"]
    edge = cp == 0
    prev, nxt = _shift(cp, -1, 0), _shift(cp, 1, 0)
    layout = _Layout(joined, cp, begin, blank, scripts[cp])

    # accents and apostrophes belong to the word before them
    joins = joining[cp]
    base = cls[np.maximum(_last(~joins), 0)]
    cls[joins & ((base == CLASS["upper"]) | (base == CLASS["lower"]))] = CLASS["lower"]
    number = cls == CLASS["number"]
    cls[np.isin(cp, [0x2E, 0x2C, 0x3A]) & _shift(number, -1, False) & _shift(number, 1, False)] = CLASS["number"]
    dot = (cp == 0x2E) & (cls == CLASS["dot"])
    cls[dot & ((prev == 0x2E) | (nxt == 0x2E))] = CLASS["ellipsis"]
    straight = cp == 0x22
    opens = straight & (_shift(blank, -1, True) | np.isin(prev, [ord(x) for x in "(（：:"])) & ~_shift(blank, 1, True)
    cls[straight] = np.where(opens, CLASS["open"], CLASS["close"])[straight]
    for m in pats["never"].finditer(joined):
        cls[m.start()] = CLASS["lower"]
    for m in pats["may"].finditer(joined):
        cls[m.start()] = CLASS["maydot"]
    for m in pats["ordinal"].finditer(joined):
        cls[m.start()] = CLASS["number"]
    for m in pats["pair"].finditer(joined):
        may = m.group("never") is None
        a, b = m.span("may" if may else "never")
        cls[a + 1 : b] = CLASS["lower"]
        cls[b - 1] = CLASS["maydot" if may else "lower"]
    for m in pats["carry"].finditer(joined):
        cls[m.start()] = CLASS["carry"]
    for a, b in layout.markers.values():
        cls[a:b] = CLASS["lower"]
        cls[a] = CLASS["marker"]

    # runs of white space: by the line breaks in them, and gaps where a script has no sentence marks
    written = ~blank
    runs = np.flatnonzero(blank & ~edge & ~_shift(blank & ~edge, -1, False))
    if len(runs):
        ends = np.flatnonzero(blank & ~edge & ~_shift(blank & ~edge, 1, False)) + 1
        newline = np.cumsum(cp == 10)
        lines = newline[ends - 1] - newline[runs - 1]
        line_of = np.searchsorted(layout.start, ends - 1, "right") - 1  # of the run's last character: of a break, the line it ends
        after = np.searchsorted(layout.start, ends, "right") - 1
        first_written = np.full(len(texts), 1 << 60)
        at = np.flatnonzero(written)
        owner = np.searchsorted(begin, at, "right") - 1
        np.minimum.at(first_written, owner, at)
        kind = np.select([lines >= 2, lines == 1], [CLASS["para"], CLASS["line"]], CLASS["space"])
        text_of = np.searchsorted(begin, runs, "right") - 1
        gap = (lines == 1) & layout.unmarked[np.minimum(after, len(layout.unmarked) - 1)] & (runs > first_written[text_of])
        a, b = prev[runs], nxt[ends - 1]
        digit = by_cp == CLASS["number"]
        breaks = (_wide(a) & (_wide(b) | digit[b])) | (_wide(b) & digit[a] & (b >= 0x0E00) & (b <= 0x0E7F))
        gap |= (lines == 0) & (runs >= layout.loose_from[line_of]) & (a != 0) & (b != 0) & breaks
        cls[runs] = np.where(gap, CLASS["gap"], kind)
    rest = blank.copy()
    rest[runs] = False
    rest &= (cls == CLASS["space"]) | (cls == CLASS["line"])

    # events: characters that can change a state. After a letter or digit, further ones, commas and odd ones change none
    same = ~rest & (cls != CLASS["space"]) & (cls != CLASS["line"]) & ~edge
    content = same & np.isin(cls, [CLASS[c] for c in ("lower", "upper", "other", "carry", "number")])
    soft = content | (same & np.isin(cls, [CLASS["punct"], CLASS["odd"]]))
    broken = _last((same & ~soft) | edge)
    before = _shift(_last(content), -1, -1)
    keep = same & ~(soft & (before > broken))
    at = np.flatnonzero(keep)
    owner = np.searchsorted(begin, at, "right") - 1
    end_before = _shift(_last(written), -1, -1) + 1
    close = np.cumsum(sizes + 1)  # the edge after each text
    whole = np.maximum(_last(written)[close] + 1 - begin, 0)
    return owner, cls[at], at - begin[owner], np.maximum(end_before[at] - begin[owner], 0), _opening(cp, begin, close), whole


def _opening(cp: np.ndarray, begin: np.ndarray, close: np.ndarray) -> np.ndarray:
    """The state each text is entered in: inside a quotation if the first quotation mark of its first paragraph closes one."""
    nxt = _shift(cp, 1, 0)
    opening, closing = np.isin(cp, [ord(x) for x in "„«「『‹“"]), np.isin(cp, [ord(x) for x in "”」』»›"])
    at = np.flatnonzero(opening | closing | (cp == 0x22) | ((cp == 10) & (nxt == 10)))
    enter = np.full(len(begin), BEGIN, np.int8)
    if not len(at):
        return enter
    k = np.searchsorted(at, begin)
    for i in np.flatnonzero((k < len(at)) & (at[np.minimum(k, len(at) - 1)] < close)):
        p = at[k[i]]
        if closing[p]:
            enter[i] = IN_QUOTE
        elif cp[p] == 0x22 and p > begin[i]:
            space = _tables()[0] == CLASS["space"]
            enter[i] = BEGIN if space[cp[p - 1]] and not space[cp[p + 1]] else IN_QUOTE
    return enter


# --- segments, functions and their composition


def _ranked(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments by size, largest first, and how many have an event at each step."""
    order = np.argsort(-sizes, kind="stable")
    steps = int(sizes.max()) if len(sizes) else 0
    return order, len(sizes) - np.searchsorted(np.sort(sizes), np.arange(steps), "right")


def functions(cls: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each segment as a function: a row of leaving states, one for every entering state; all segments step together."""
    to, _ = transducer()
    sizes = np.diff(offsets)
    order, active = _ranked(sizes)
    f = np.tile(np.arange(len(STATES), dtype=np.int8), (len(sizes), 1))
    first = offsets[:-1][order]
    for t, n in enumerate(active):
        f[:n] = to[f[:n], cls[first[:n] + t][:, None]]
    out = np.empty_like(f)
    out[order] = f
    return out


def begins(cls: np.ndarray, offsets: np.ndarray, enter: np.ndarray) -> np.ndarray:
    """Before which events a sentence begins, each segment read from the state it is entered in."""
    to, out = transducer()
    order, active = _ranked(np.diff(offsets))
    state = enter[order].astype(np.int8)
    first = offsets[:-1][order]
    hits = np.zeros(len(cls), bool)
    for t, n in enumerate(active):
        at = first[:n] + t
        c = cls[at]
        hits[at] = out[state[:n], c]
        state[:n] = to[state[:n], c]
    return hits


_SEGMENTS = "n int, enter tinyint, last boolean, stop int, cls array<tinyint>, pos array<int>, ends array<int>"


def _by_chars(batch: pa.RecordBatch, chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``chars`` characters; one longer text is a batch of its own."""
    at = n = 0
    for i, t in enumerate(batch.column("text")):
        s = len(t.as_py())
        if i > at and n + s > chars:
            yield batch.slice(at, i - at)
            at, n = i, 0
        n += s
    if at < batch.num_rows:
        yield batch.slice(at)


def _segments_of(segment: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for y in batches for x in _by_chars(y)):
            owner, cls, pos, ends, enter, whole = lex(b.column("text").to_pylist())
            if not len(owner):
                continue
            first = np.searchsorted(owner, owner)  # of the event's text
            number = (np.arange(len(owner)) - first) // segment
            head = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(number) != 0)]))
            offsets = np.append(head, len(owner)).astype(np.int32)
            text = owner[head]
            last = np.append(text[1:] != text[:-1], True)
            stop = np.where(last, whole[text], np.append(ends[head[1:]], 0))
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x, t)) for x, t in ((cls.astype(np.int8), pa.int8()), (pos.astype(np.int32), pa.int32()), (ends.astype(np.int32), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(text)), pa.array(number[head].astype(np.int32)), pa.array(enter[text]), pa.array(last), pa.array(stop.astype(np.int32)), *lists], names=["id", "n", "enter", "last", "stop", "cls", "pos", "ends"])

    return run


def _flat(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False)


def _offsets(b: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(b.column("cls").value_lengths().to_numpy(zero_copy_only=False))])


def _functions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            f = functions(_flat(b, "cls"), _offsets(b))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, f.shape[1]), pa.int32()), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), lists], names=["id", "n", "f"])


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sentences and parts of sentences of each segment: offsets, whether the part goes on from before, and whether it is whole."""
    for b in batches:
        if not b.num_rows:
            continue
        offsets = _offsets(b)
        hits = begins(_flat(b, "cls"), offsets, b.column("state").to_numpy(zero_copy_only=False))
        pos, ends = _flat(b, "pos"), _flat(b, "ends")
        lead = np.zeros(len(hits), bool)
        lead[offsets[:-1]] = True
        cls = _flat(b, "cls")
        # a segment's first part goes on from the one before unless a sentence begins with it
        blank = (cls == CLASS["para"]) | (cls == CLASS["gap"])
        start = np.flatnonzero(hits | lead)
        segment = np.searchsorted(offsets, start, "right") - 1
        final = np.append(segment[1:] != segment[:-1], True)
        end = np.where(final, b.column("stop").to_numpy(zero_copy_only=False)[segment], np.append(ends[start[1:]], 0))
        goes_on = ~hits[start]
        last = b.column("last").to_numpy(zero_copy_only=False)[segment]
        whole = ~goes_on & (~final | last)
        keep = ~(goes_on & blank[start] & (end <= pos[start]))
        pick = pa.array(segment[keep])
        yield pa.RecordBatch.from_arrays(
            [b.column("id").take(pick), b.column("n").take(pick), pa.array(pos[start][keep].astype(np.int32)), pa.array(end[keep].astype(np.int32)), pa.array(goes_on[keep]), pa.array(whole[keep])],
            names=["id", "n", "s", "e", "goes_on", "whole"],
        )


def scan(f: DataFrame, longest: int) -> DataFrame:
    """``id``, ``n`` and the composition ``f`` of the functions of segments 0 to n.

    Round k composes each function with the one 2**k segments before it, which then covers that many, so the rounds grow
    with the logarithm of the longest text's segments, and no task sees more than pairs of functions.
    """
    reach = 1
    while reach < longest:
        ahead = f.select("id", (F.col("n") + reach).alias("n"), F.col("f").alias("g"))
        both = F.when(F.col("g").isNull(), F.col("f")).otherwise(F.transform("g", lambda s: F.element_at(F.col("f"), s.cast("int") + 1)))
        f = cut(f.join(ahead, ["id", "n"], "left").select("id", "n", both.alias("f")))
        reach *= 2
    return f


def sentence_spans(df: DataFrame, key: str, column: str, segment: int | None = None) -> DataFrame:
    """``key``, ``start_char``, ``end_char`` of every sentence; ``key`` must name one row."""
    rows = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).alias("id"), F.col(column).alias("text"))
    kind = f"`id` {df.schema[key].dataType.simpleString()}"
    parts = cut(rows.mapInArrow(_segments_of(segment or SEGMENT), f"{kind}, {_SEGMENTS}"))
    longest = (parts.agg(F.max("n")).head()[0] or 0) + 1
    state = parts.where("n = 0").withColumn("state", F.col("enter"))
    if longest > 1:
        f = cut(parts.where("not last").select("id", "n", "cls").mapInArrow(_functions, f"{kind}, n int, f array<tinyint>"))
        before = scan(f, longest).select("id", (F.col("n") + 1).alias("n"), "f")
        later = parts.where("n > 0").join(before, ["id", "n"])
        state = state.unionByName(later.withColumn("state", F.element_at("f", F.col("enter").cast("int") + 1)).drop("f"))
    pieces = state.mapInArrow(_pieces, f"{kind}, n int, s int, e int, goes_on boolean, whole boolean")
    if longest == 1:
        return pieces.select(F.col("id").alias(key), F.col("s").alias("start_char"), F.col("e").alias("end_char"))
    pieces = cut(pieces)
    torn = pieces.where("not whole")
    number = F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(Window.partitionBy("id").orderBy("n", "s"))
    joined = torn.select("id", "s", "e", number.alias("no")).groupBy("id", "no").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return pieces.where("whole").select("id", "s", "e").unionByName(joined.select("id", "s", "e")).select(F.col("id").alias(key), F.col("s").alias("start_char"), F.col("e").alias("end_char"))


# --- kinds


def kind_of(sentence: str, alone: bool) -> str:
    """``item``, ``data``, ``heading`` or ``sentence``; ``alone``: it is a paragraph by itself."""
    m = _patterns()["marker"].match(sentence)
    if m and m.end() < len(sentence) and not (alone and _patterns()["heading"].match(sentence) and len(sentence) < 40):
        return "item"
    if len(sentence) >= 40 and sentence.isascii() and not any(map(str.isspace, sentence)):
        return "data"
    if alone and len(sentence) <= 60 and not _patterns()["ended"].search(sentence):
        return "heading"
    return "sentence"


_OUTER = " \t　"


def _alone(text: str, s: int, e: int) -> bool:
    """Whether nothing else stands on the lines of a sentence."""
    while s > 0 and text[s - 1] in _OUTER:
        s -= 1
    while e < len(text) and text[e] in _OUTER:
        e += 1
    return (s == 0 or text[s - 1] == "\n") and (e == len(text) or text[e] == "\n")


def _described(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for i, text, spans in zip(b["id"], b["text"], b["spans"]):
            for s, e in sorted((x["s"], x["e"]) for x in spans):
                out.append((i, s, e, kind_of(text[s:e], _alone(text, s, e)), text[s:e]))
        yield pd.DataFrame(out, columns=["id", "start_char", "end_char", "kind", "content"])


def split_sentences(df: DataFrame, key: str, column: str, segment: int | None = None) -> DataFrame:
    """``key``, ``start_char``, ``end_char``, ``kind``, ``content`` of every sentence; ``key`` must name one row.

    A text's spans are gathered beside it, so a row is as large as its text.
    """
    spans = sentence_spans(df, key, column, segment)
    gathered = spans.groupBy(F.col(key).alias("id")).agg(F.collect_list(F.struct(F.col("start_char").alias("s"), F.col("end_char").alias("e"))).alias("spans"))
    texts = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).alias("id"), F.col(column).alias("text"))
    kind = df.schema[key].dataType.simpleString()
    return texts.join(gathered, "id").mapInPandas(_described, f"id {kind}, start_char int, end_char int, kind string, content string").withColumnRenamed("id", key)
