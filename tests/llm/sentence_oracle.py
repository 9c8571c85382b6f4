"""Brute force for sentences: one token after the other, each text whole, with the rules written as a loop over tokens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

from lodestrand.llm.sentences import CARRY_ON, GERMAN_MONTHS, MAY_END, NEVER_END, PAIRS_MAY, PAIRS_NEVER

# Token classes.
CLASSES = ["space", "line", "para", "gap", "lower", "upper", "other", "carry", "number", "hard", "dot", "maydot", "ellipsis", "open", "close", "toggle", "intro", "punct", "marker", "odd"]
CLASS = {c: i for i, c in enumerate(CLASSES)}
# State: quotation (none, said, other), whether its last token ended a sentence, what ended, whether a colon or comma stands before.
QUOTES, ENDED = ("none", "said", "plain"), ("start", "none", "dot", "hard", "maydot", "ellipsis", "saidquote", "quote")
STATES = list(product(QUOTES, (0, 1), ENDED, (0, 1)))
STATE = {s: i for i, s in enumerate(STATES)}
BEGIN, IN_QUOTE = STATE[("none", 0, "start", 0)], STATE[("said", 0, "start", 0)]


def _step(state: tuple, c: str) -> tuple[tuple, bool]:
    """The next state and whether a sentence begins before the token."""
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


@lru_cache(maxsize=1)
def transducer() -> tuple[list[list[int]], list[list[bool]]]:
    """Tables of next states and outputs by state and token class."""
    to, out = [], []
    for s in STATES:
        row = [_step(s, c) for c in CLASSES]
        to.append([STATE[n] for n, _ in row])
        out.append([b for _, b in row])
    return to, out


@lru_cache(maxsize=1)
def _lexer():
    import regex

    words = lambda ws: "|".join(sorted(map(regex.escape, ws), key=len, reverse=True))
    return regex.compile(
        rf"""
        (?P<para>[^\S\n]*\n(?:[^\S\n]*\n)+[^\S\n]*)
      | (?P<line>[^\S\n]*\n[^\S\n]*)
      | (?P<space>[^\S\n]+)
      | (?P<pairnever>\b(?:{PAIRS_NEVER}))
      | (?P<pairmay>\b(?:{PAIRS_MAY}))
      | (?P<ordinal>\d{{1,2}}\.(?=\s+(?:{GERMAN_MONTHS})\b))
      | (?P<number>\d+(?:[.,:]\d+)*)
      | (?P<never>(?<![\p{{Latin}}\p{{N}}])(?:{words(NEVER_END)})\.(?!\.))
      | (?P<may>(?<![\p{{Latin}}\p{{N}}])(?:{words(MAY_END)})\.(?!\.))
      | (?P<upper>[\p{{Lu}}\p{{Lt}}][\p{{L}}--[\p{{Lo}}]][\p{{Lu}}\p{{Ll}}\p{{Mn}}'’]*|[\p{{Lu}}\p{{Lt}}])
      | (?P<lower>\p{{Ll}}[\p{{Lu}}\p{{Ll}}\p{{Mn}}'’]*)
      | (?P<carry>(?:{words(CARRY_ON)})(?=[\p{{L}}\p{{M}}\s])|随\Z)
      | (?P<other>[\p{{Lo}}\p{{Lm}}\p{{M}}]+)
      | (?P<ellipsis>\.\.+|…+|⋯+)
      | (?P<hard>[。！？!?।॥؟｡]+)
      | (?P<dot>\.)
      | (?P<open>[„«「『‹])
      | (?P<close>[”」』»›）)\]】》])
      | (?P<toggle>[“"])
      | (?P<intro>[:：])
      | (?P<punct>[,，、;；،])
      | (?P<odd>.)
        """,
        regex.VERBOSE | regex.V1,
    )


_MARK = r"[-•*–·▪●○](?=[^\S\n])|[(（]\d{1,3}[)）]|\d{1,3}[)）]|[①-⑳]|[(（][一二三四五六七八九十]{1,3}[)）]|[一二三四五六七八九十]{1,3}、"
_NUMBERED = r"\d{1,3}\.(?=[^\S\n])"


@lru_cache(maxsize=1)
def _patterns():
    import regex

    return {
        "marker": regex.compile(rf"[^\S\n]*(?:(?P<sure>{_MARK})|(?P<num>{_NUMBERED}))"),
        "ended": regex.compile(r"[。！？!?।.…][”“\"»」』)）]*\s*\Z"),
        "heading": regex.compile(r"[^\S\n]*(?:第\s*\d+\s*[节章条部]|\d+(?:\.\d+)*\.?|[(（]?[一二三四五六七八九十]+[)）、.])[^\S\n]+[^\s。，,.]{1,24}[^\S\n]*\Z"),
        "script": regex.compile(r"(?P<thai>\p{Thai})|(?P<cjk>[\p{Han}\p{Hiragana}\p{Katakana}])|(?P<latin>[\p{Latin}\p{Cyrillic}\p{Greek}])|(?P<indic>\p{Devanagari})"),
        "mark": regex.compile(r"[。！？।॥؟｡!?]"),
        "stop": regex.compile(r"[.!?][”\"»)]?(?=\s|\Z)"),
    }


def _script(line: str) -> str:
    counts = {"thai": 0, "cjk": 0, "latin": 0, "indic": 0}
    for m in _patterns()["script"].finditer(line):
        counts[m.lastgroup] += 1
    if counts["cjk"] * 2 >= counts["latin"] and counts["cjk"] > 0 and counts["thai"] == 0:
        return "cjk"
    return max(counts, key=lambda k: counts[k])


def marked_scripts(text: str) -> set[str]:
    """The scripts whose paragraphs in ``text`` have sentence marks; Thai has none."""
    import regex

    pats = _patterns()
    out = set()
    for para in regex.split(r"\n\s*\n", text):
        script = _script(para)
        mark = pats["stop" if script == "latin" else "mark"]
        if script not in out and any(mark.search(line, m.end() if (m := pats["marker"].match(line)) else 0) for line in para.split("\n")):
            out.add(script)
    return out - {"thai"}


def tokens(text: str, with_marks: set[str], continued: bool = False) -> Iterator[tuple[int, int, int]]:
    """Class, start and end of each token. ``continued``: the text goes on from a segment that did not end at a line's end."""
    pats = _patterns()
    # lines: where they are list items, and where breaks and spaces count
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    markers: dict[int, int] = {}
    loose: list[tuple[int, int]] = []  # stretches in which breaks and spaces count
    before_blank, before_marker = not continued, False
    kinds = [pats["marker"].match(line) for _, line in lines]
    paragraph_of, n = [], 0
    for _, line in lines:
        n += not line.strip()
        paragraph_of.append(n)
    by_para: dict[int, str] = {}
    for (_, line), k in zip(lines, paragraph_of):
        by_para[k] = by_para.get(k, "") + line
    scripts = {k: _script(v) for k, v in by_para.items()}
    for i, (start, line) in enumerate(lines):
        m = kinds[i]
        if not line.strip():
            before_blank, before_marker = True, False
            continue
        is_marker = False
        if m is not None and not (continued and i == 0):
            if m.group("sure"):
                is_marker = True
            elif before_blank or before_marker:
                is_marker = not _month_after(line, m.end())
            else:
                following = kinds[i + 1] if i + 1 < len(kinds) else None
                is_marker = bool(following and following.group("num")) or (i == 1 and not pats["ended"].search(line) and not pats["ended"].search(lines[0][1]))
                is_marker = is_marker and not _month_after(line, m.end())
        if is_marker:
            markers[start + len(m.group(0)) - len((m.group("sure") or m.group("num")))] = start + m.end()
        if scripts[paragraph_of[i]] not in with_marks:
            body = start + (m.end() if is_marker else 0)
            if not pats["heading"].match(line):
                loose.append((body, start + len(line)))
        before_blank, before_marker = False, is_marker
    yield from _scan(text, markers, loose, scripts, paragraph_of, lines, with_marks)


def _month_after(line: str, at: int) -> bool:
    return line[at:].lstrip().startswith(tuple(GERMAN_MONTHS.split("|")))


def _scan(text, markers, loose, scripts, paragraph_of, lines, with_marks) -> Iterator[tuple[int, int, int]]:
    scan = _lexer().match
    spans = iter(loose)
    span = next(spans, None)
    starts = {start: i for i, (start, _) in enumerate(lines)}
    at, size = 0, len(text)
    while at < size:
        if at in markers:
            yield CLASS["marker"], at, markers[at]
            at = markers[at]
            continue
        m = scan(text, at)
        kind, end = m.lastgroup, m.end()
        if kind in ("pairnever", "never", "pairmay", "may"):
            word = end - 1
            yield CLASS["upper" if text[at].isupper() else "lower"], at, word
            if kind.endswith("may"):
                yield CLASS["maydot"], word, end
            else:
                yield CLASS["lower"], word, end
        elif kind == "ordinal":
            yield CLASS["number"], at, end
        elif kind == "toggle":
            before, after = text[at - 1] if at else " ", text[end] if end < size else " "
            if text[at] == '"':
                kind = "open" if (before.isspace() or before in "(（：:") and not after.isspace() else "close"
            yield CLASS[kind], at, end
        elif kind in ("line", "space"):
            while span is not None and span[1] < at:
                span = next(spans, None)
            if kind == "line":
                i = starts.get(text.rfind("\n", at, end) + 1)
                unmarked = i is not None and scripts[paragraph_of[i]] not in with_marks
                kind = "gap" if unmarked and text[:at].strip() else kind
            elif span is not None and span[0] <= at and end <= span[1] and at > 0 and end < size and _breaks(text[at - 1], text[end]):
                kind = "gap"
            yield CLASS[kind], at, end
        else:
            yield CLASS[kind], at, end
        at = end


def _breaks(a: str, b: str) -> bool:
    """Whether a space between two characters of a text without sentence marks stands where a sentence ends."""
    wide = lambda c: "⺀" <= c <= "鿿" or "฀" <= c <= "๿" or c in "）”“（」』"
    return (wide(a) and (wide(b) or b.isdigit())) or (wide(b) and a.isdigit() and "฀" <= b <= "๿")


def opening_state(text: str) -> int:
    """The state a text is entered in: inside a quotation if the first quotation mark of its first paragraph closes one."""
    for i, c in enumerate(text):
        if c == "\n" and text[i + 1 : i + 2] == "\n":
            break
        if c in "„«「『‹“":
            break
        if c in "”」』»›":
            return IN_QUOTE
        if c == '"':
            before, after = text[i - 1] if i else " ", text[i + 1] if i + 1 < len(text) else " "
            return BEGIN if before.isspace() and not after.isspace() else IN_QUOTE if i else BEGIN
    return BEGIN


def read(text: str, state: int, with_marks: set[str], continued: bool = False) -> tuple[list[tuple[int, int]], bool, int]:
    """Sentence spans of a segment, whether the first one goes on from the segment before, and the leaving state."""
    to, out = transducer()
    spans: list[list[int]] = []
    goes_on = False
    blank = (CLASS["space"], CLASS["line"], CLASS["para"], CLASS["gap"])
    for c, a, b in tokens(text, with_marks, continued):
        begins = out[state][c]
        state = to[state][c]
        if c in blank:
            continue
        if begins:
            spans.append([a, b])
        elif spans:
            spans[-1][1] = b
        else:
            goes_on = True
            spans.append([a, b])
    return [(a, b) for a, b in spans], goes_on, state


def _alone(text: str, s: int, e: int) -> bool:
    before, after = text[:s].rstrip(" \t　"), text[e : e + 8].lstrip(" \t　")
    return (not before.strip() or before.endswith("\n")) and (not after.strip() or after.startswith("\n"))


def spans(text: str) -> list[tuple[int, int]]:
    """The sentences of a text."""
    return read(text, opening_state(text), marked_scripts(text))[0]
