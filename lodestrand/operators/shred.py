"""Nested records to flat tables by columnar shredding.

``shred`` turns each JSON record, in one walk, into one row per leaf path with parallel sequences: the repetition level
(at which repeated ancestor a new item began), the definition level (how much of the path exists), the value, and, where a
list leaves places out, how many at each level. ``assemble`` rebuilds, from the level sequences alone and where the
row lies, the flat table of a repeated ancestor with the place of every item and the path of its parent.

Lists may be written as a JSON list, as an object with numbers for names, as one object standing alone, or as text that
holds any of these, however often it was encoded; names compare in lower case. Records that cannot be read, are null or
hold no object give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KIND = "@kind"


@dataclass(frozen=True)
class Leaf:
    """A leaf path such as ``edges[].evidence[].unit_id``; ``[]`` marks a repeated ancestor."""

    path: str

    @property
    def steps(self) -> list[tuple[str, bool]]:
        return [(p.removesuffix("[]").lower(), p.endswith("[]")) for p in self.path.split(".")]

    @property
    def groups(self) -> list[int]:
        """Number of steps up to and with each repeated ancestor."""
        return [i + 1 for i, (_, rep) in enumerate(self.steps) if rep]


def kind_leaf(group: str) -> Leaf:
    """The leaf that says of each item of the repeated ``group`` whether it is an object."""
    return Leaf(f"{group}.{KIND}")


def _decode(v):
    """``v``, or what it holds if it is text that holds a JSON list or object (however often it was encoded)."""
    while isinstance(v, str) and v.lstrip()[:1] in ("{", "[", '"'):
        try:
            v = json.loads(v)  # each decoding leaves less text
        except (ValueError, RecursionError):
            return v
    return v


def _object(v) -> dict | None:
    v = _decode(v)
    return v if isinstance(v, dict) else None


def _get(o: dict, name: str):
    if name in o:
        return o[name]
    for k, v in o.items():
        if k.lower() == name:
            return v
    return None


def _items(v) -> list[tuple[int, object]]:
    """Places and items of a list; an object with numbers for names may leave places out."""
    v = _decode(v)
    if isinstance(v, list):
        return list(enumerate(v))
    if isinstance(v, dict):
        if v and all(k.isdecimal() for k in v):
            return sorted({int(k): x for k, x in v.items()}.items())
        return [(0, v)] if v else []
    return []


def _scalar(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    text = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return text.encode("utf-8", "replace").decode("utf-8")


class _Plan:
    """Leaf paths as a tree, so that a record is walked and each of its parts decoded once."""

    def __init__(self, leaves: list[Leaf]):
        self.paths = [leaf.path for leaf in leaves]
        self.root: dict = {}
        for n, leaf in enumerate(leaves):
            node = self.root
            for step in leaf.steps:
                node = node.setdefault(step, {})
            node.setdefault(None, []).append(n)

    def read(self, record: dict) -> list[tuple[list[int], list[int], list[str | None], list[list[int] | None]]]:
        """Repetition levels, definition levels, values and gaps of every leaf path in one record."""
        out: list[tuple] = [([], [], [], []) for _ in self.paths]

        def put(n: int, r: int, d: int, v: str | None, gaps: tuple[int, ...]) -> None:
            for to, x in zip(out[n], (r, d, v, list(gaps) if any(gaps) else None)):
                to.append(x)

        def missing(node: dict, r: int, d: int, gaps: tuple[int, ...]) -> None:
            for step, child in node.items():
                if step is None:
                    for n in child:
                        put(n, r, d, None, gaps)
                else:
                    missing(child, r, d, gaps)

        def walk(v, node: dict, r: int, d: int, rep: int, gaps: tuple[int, ...]) -> None:
            o = _object(v)
            for step, child in node.items():
                if step is None:
                    for n in child:
                        put(n, r, d, _scalar(v), gaps)
                    continue
                name, repeated = step
                if name == KIND:
                    for n in child.get(None, ()):
                        put(n, r, d, "object" if o is not None else "other", gaps)
                    continue
                inner = None if o is None else _get(o, name)
                if inner is None:
                    missing(child, r, d, gaps)
                elif not repeated:
                    walk(inner, child, r, d + 1, rep, gaps)
                else:
                    items = _items(inner)
                    if not items:
                        missing(child, r, d, gaps)
                    before = -1
                    for k, (place, item) in enumerate(items):
                        # a gap belongs to the level that moves: the list's own, or at its first item also those outside
                        here = (gaps if k == 0 else (0,) * rep) + (place - before - 1,)
                        walk(item, child, r if k == 0 else rep + 1, d + 1, rep + 1, here)
                        before = place

        walk(record, self.root, 0, 0, 0, ())
        return out


def levels(record: dict, steps: list[tuple[str, bool]]) -> tuple[list[int], list[int], list[str | None]]:
    """Repetition levels, definition levels and values of one leaf path in one record."""
    path = ".".join(n + ("[]" if rep else "") for n, rep in steps)
    return _Plan([Leaf(path)]).read(record)[0][:3]


_SHREDDED = "rec_id string, leaf string, rs array<int>, ds array<int>, vs array<string>, gs array<array<bigint>>"


def shred(df: DataFrame, key: str, column: str, leaves: list[Leaf]) -> DataFrame:
    """One row per record and leaf path: ``rec_id``, ``leaf``, ``rs``, ``ds`` (levels), ``vs`` (values), ``gs`` (places left out).

    ``key`` must name one row per record. Null keys and unreadable, null, empty or non-object records give no rows.
    """
    plan = _Plan(leaves)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("rec_id", "leaf", "rs", "ds", "vs", "gs")}
            for k, text in zip(b["rec_id"], b["body"]):
                record = _object(text)
                if record is None:
                    continue
                for path, (rs, ds, vs, gs) in zip(plan.paths, plan.read(record)):
                    if len(ds) == 1 and vs[0] is None and ds[0] == 0:
                        continue
                    for c, x in zip(out, (k, path, rs, ds, vs, gs if any(gs) else None)):
                        out[c].append(x)
            yield pd.DataFrame({c: pd.Series(x, dtype=object) for c, x in out.items()})

    source = df.select(F.col(key).cast("string").alias("rec_id"), F.col(column).alias("body")).where("rec_id is not null and body is not null")
    return source.mapInPandas(run, _SHREDDED)


def places(rs: Iterable[int], gs: Iterable[list[int] | None] | None, depth: int) -> Iterator[list[int]]:
    """The place at each repeated level of every entry: a level counts on where it is the repetition level and begins anew
    where a level outside it moved, beyond the places left out."""
    at = [0] * depth
    gaps = iter(gs) if gs is not None else None
    for n, r in enumerate(rs):
        if n and r:
            at[r - 1] += 1
        for j in range(r if n else 0, depth):
            at[j] = 0
        if gaps is not None and (g := next(gaps)) is not None:
            for j in range(max(r - 1, 0), min(depth, len(g))):
                at[j] += g[j]
        yield list(at)


def assemble(shredded: DataFrame, leaves: list[Leaf]) -> DataFrame:
    """The items of the innermost repeated ancestor of each leaf: ``rec_id``, ``leaf``, ``parent_path``, ``path``, ``val``.

    An item exists where the definition level reaches its ancestor. Every row holds all levels of its record and leaf, so
    the table is rebuilt where the row lies, without a shuffle.
    """
    plan = {}
    for leaf in leaves:
        steps = leaf.steps[: leaf.groups[-1]]
        plan[leaf.path] = (leaf.groups[-1], len(leaf.groups), [(name, rep) for name, rep in steps])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for rec, path, rs, ds, vs, gs in zip(b["rec_id"], b["leaf"], b["rs"], b["ds"], b["vs"], b["gs"]):
                least, depth, steps = plan[path]
                for at, d, v in zip(places(rs, gs, depth), ds, vs):
                    if d < least:
                        continue
                    names: list[str] = []
                    level = 0
                    for name, rep in steps:
                        names.append(name)
                        if rep:
                            names.append(str(at[level]))
                            level += 1
                    out.append((rec, path, "/".join(names[:-2]), "/".join(names), v))
            yield pd.DataFrame(out, columns=["rec_id", "leaf", "parent_path", "path", "val"])

    known = shredded.where(F.col("leaf").isin(list(plan)))
    return known.mapInPandas(run, "rec_id string, leaf string, parent_path string, path string, val string")


def latest_version(df: DataFrame, key: str, stamp: str, body: str) -> DataFrame:
    """``key`` and ``body`` of the row with the largest ``stamp`` of each key; ties go to the largest body.

    A null stamp loses to any other; a null key gives no row. Partial maxima are taken before the shuffle.
    """
    best = F.max(F.struct(F.coalesce(F.col(stamp).cast("string"), F.lit("")).alias("s"), F.col(body).alias("b")))
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias(key)).agg(best.alias("x")).select(key, F.col("x.b").alias(body))
