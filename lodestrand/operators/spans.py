"""Spans of texts: sentence and paragraph splitters with offsets, span search, report segments.

Offsets count characters from 0, ends are exclusive. Null and empty texts have no spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_END = re.compile(r"[。！？!?；;]+[”’」』）)\"']*|\.(?=\s|$)|\n+")
_SOFT = re.compile(r"[，,、：:]")
_HEADING = re.compile(r"^\s*(?:第[一二三四五六七八九十0-9]+[章节部分条]|[一二三四五六七八九十]+[、.]|\d+(?:\.\d+)*[、.）)\s])\s*\S.{0,60}$")
_BULLET = re.compile(r"^\s*(?:[-•*]|\(\d+\)|\d+[).])\s")


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def shorten(text: str, a: int, b: int, limit: int) -> list[tuple[int, int]]:
    """A span over the limit cut at the last soft mark within it, else at the limit."""
    out = []
    while b - a > limit:
        marks = [m.end() for m in _SOFT.finditer(text, a, a + limit)]
        at = marks[-1] if marks and marks[-1] > a else a + limit
        out.append((a, at))
        a = at
    return [*out, (a, b)]


def sentences(text: str, limit: int = 400) -> list[tuple[int, int]]:
    """Sentence spans of at most ``limit`` characters."""
    out, at = [], 0
    for m in [*_END.finditer(text), None]:
        end = m.end() if m else len(text)
        for a, b in shorten(text, *_trim(text, at, end), limit):
            a, b = _trim(text, a, b)
            if a < b:
                out.append((a, b))
        at = end
    return out


def is_heading(line: str) -> bool:
    """A numbered or named heading of one short line."""
    return bool(_HEADING.match(line)) and not line.rstrip().endswith(("。", "；", ";", "."))


def paragraphs(text: str, limit: int = 1200) -> list[tuple[int, int]]:
    """Paragraphs: a blank line, a heading or a list item begins one; longer ones are packed line by line to the limit."""
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, at + len(line), line))
        at += len(line) + 1
    groups: list[list[tuple[int, int, str]]] = []
    new = True
    for item in lines:
        if not item[2].strip():
            new = True
            continue
        head = is_heading(item[2])
        if new or head or _BULLET.match(item[2]):
            groups.append([])
        groups[-1].append(item)
        new = head
    out = []
    for g in groups:
        a, b = g[0][0], g[0][1]
        for s, e, _ in g[1:]:
            if e - a > limit:
                out += shorten(text, a, b, limit)
                a = s
            b = e
        out += shorten(text, a, b, limit)
    return [x for x in (_trim(text, a, b) for a, b in out) if x[0] < x[1]]


def find_fuzzy(text: str, phrase: str, least: float = 0.70) -> tuple[int, int] | None:
    """The first exact place regardless of case, else the window of the phrase's length most alike it, if alike enough."""
    if not text or not phrase:
        return None
    at = text.lower().find(phrase.lower())
    if at >= 0:
        return at, at + len(phrase)
    best, where = 0.0, None
    n = min(len(phrase), len(text))
    m = SequenceMatcher(None, "", phrase.lower())
    for i in range(len(text) - n + 1):
        m.set_seq1(text[i : i + n].lower())
        if m.real_quick_ratio() > best and m.quick_ratio() > best and (r := m.ratio()) > best:
            best, where = r, (i, i + n)
    return where if best >= least else None


def report_role(text: str) -> str:
    """The first role of outcome, harm, initial and intermediate whose words occur, else other."""
    for role, words in REPORT_ROLES:
        if any(w in text for w in words):
            return role
    return "other"


# Words of the roles of report segments, the first role that matches counts.
REPORT_ROLES = [("outcome", ["死亡", "受伤", "轻伤", "重伤", "损失"]), ("harm", ["坠落", "坍塌", "爆炸", "触电", "倾斜", "断裂", "起火"]), ("initial", ["由于", "未", "违章", "缺失", "磨损"]), ("intermediate", ["导致", "随后", "引发", "使得"])]


def span_table(df: DataFrame, key: str, column: str, splitter: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    """``key``, ``idx``, ``start_char``, ``end_char``, ``content`` of the spans of every text; ``key`` must name one row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i, s, e, t[s:e]) for k, t in zip(b["k"], b["t"]) for i, (s, e) in enumerate(splitter(t))]
            yield pd.DataFrame(out, columns=["k", "idx", "start_char", "end_char", "content"])

    rows = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).alias("k"), F.col(column).alias("t"))
    return rows.mapInPandas(run, f"k {kind}, idx int, start_char int, end_char int, content string").withColumnRenamed("k", key)


def find_span(text: str | Column, snippet: str | Column) -> Column:
    """Where a snippet begins (from 0): exactly, else where its first twelve characters do, with white space as one space; -1 if nowhere."""
    t, s = (F.col(x) if isinstance(x, str) else x for x in (text, snippet))
    exact = F.instr(t, s)
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    rough = F.instr(flat(t), F.substring(flat(s), 1, 12))
    return F.when((s == "") | s.isNull() | t.isNull(), -1).when(exact > 0, exact - 1).when(rough > 0, rough - 1).otherwise(-1)
