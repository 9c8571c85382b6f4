"""Nested records: shredding, assembling, and a brute-force walk of the same records."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from lodestrand.operators.shred import Leaf, assemble, kind_leaf, latest_version, levels, shred


def found(spark, records, groups, extra=None):
    df = spark.createDataFrame([(f"r{i}", r, "noise") for i, r in enumerate(records)], "rec_id string, body string, leaf string")
    leaves = [kind_leaf(g) for g in groups]
    return rows(assemble(shred(df, "rec_id", "body", leaves), leaves).where("val = 'object'").select("rec_id", "parent_path", "path"))


def test_list_however_written(spark):
    recs = ['{"edges": [{"a": 1}, null, 3, {"a": 2}]}', '{"EDGES": {"0": {"a": 1}, "1": {"a": 2}}}', '{"edges": {"a": 1}}', '{"edges": "[{\\"a\\": 1}]"}', json.dumps('{"edges": [{"a": 1}]}')]
    assert found(spark, recs, ["edges[]"]) == [("r0", "", "edges/0"), ("r0", "", "edges/3"), ("r1", "", "edges/0"), ("r1", "", "edges/1"), ("r2", "", "edges/0"), ("r3", "", "edges/0"), ("r4", "", "edges/0")]


def test_parents(spark):
    rec = '{"edges": [{"evidence": [{"spans": [{}, {}]}, {"spans": []}]}, {"review": {"notes": [{"t": 1}]}, "evidence": [{"spans": {"s": 1}}]}], "branch": {"ranking": [{"c": 1}]}}'
    got = found(spark, [rec], ["edges[].evidence[].spans[]", "edges[].review.notes[]", "branch.ranking[]"])
    assert [g[1:] for g in got] == [("branch", "branch/ranking/0"), ("edges/0/evidence/0", "edges/0/evidence/0/spans/0"), ("edges/0/evidence/0", "edges/0/evidence/0/spans/1"), ("edges/1/evidence/0", "edges/1/evidence/0/spans/0"), ("edges/1/review", "edges/1/review/notes/0")]


def test_unreadable_and_empty(spark):
    assert found(spark, [None, "", "{bad", "null", "3", "[]", "{}", '{"edges": null}', '{"edges": []}'], ["edges[]"]) == []
    empty = spark.createDataFrame([], "rec_id string, body string")
    assert assemble(shred(empty, "rec_id", "body", [kind_leaf("a[]")]), [kind_leaf("a[]")]).count() == 0


def test_levels_of_the_example_of_two_documents():
    steps = Leaf("links[].forward[]").steps
    assert levels({"links": [{"forward": [20, 40]}, {}, {"forward": [60]}]}, steps) == ([0, 2, 1, 1], [2, 2, 1, 2], ["20", "40", None, "60"])
    assert levels({}, steps) == ([0], [0], [None])


def test_long_list(spark):
    rec = json.dumps({"a": [{"b": [{}] * 3}] * 700})
    assert len(found(spark, [rec], ["a[].b[]"])) == 2100


def test_latest_version(spark):
    df = spark.createDataFrame([("a", "2024-01-01", "x", 1), ("a", "2024-02-01", "y", 2), ("a", None, "z", 3), ("b", None, None, 4), (None, "2024", "q", 5), ("a", "2024-02-01", "y", 2)], "k string, u string, body string, s int")
    assert rows(latest_version(df, "k", "u", "body").select("k", "body")) == [("a", "y"), ("b", None)]


items = st.recursive(st.none() | st.integers(0, 3) | st.text("ab", max_size=2), lambda s: st.lists(s, max_size=3) | st.fixed_dictionaries({}, optional={"a": s, "b": s}), max_leaves=12)


def walk(v, path, out, names):
    if not names or not isinstance(v, dict):
        return
    c = v.get(names[0])
    if isinstance(c, dict):
        c = [c] if c else []
    if not isinstance(c, list):
        return
    for i, x in enumerate(c):
        p = f"{path}/{names[0]}/{i}".strip("/")
        if isinstance(x, dict):
            if len(names) == 1:
                out.append((path, p))
            walk(x, p, out, names[1:])


@settings(max_examples=15, deadline=None)
@given(recs=st.lists(st.fixed_dictionaries({}, optional={"a": items, "b": items}), min_size=1, max_size=6))
def test_against_a_walk(spark, recs):
    want = []
    for i, r in enumerate(recs):
        out = []
        walk(r, "", out, ["a", "b"])
        want += [(f"r{i}", *x) for x in out]
    assert found(spark, [json.dumps(r) for r in recs], ["a[].b[]"]) == sorted(want)


def test_query_columns(spark, small):
    from lodestrand.plans.records import p3_found

    df = p3_found(spark, small)
    assert df.columns == ["tbl", "rec_id", "parent_path", "path"] and df.count() == df.distinct().count() > 0
    pytest.importorskip("duckdb")


def test_places_left_out_however_far(spark):
    recs = ['{"a": {"0": {}, "5000": {}}}', '{"a": {"3": {"b": {"2": {}, "1000000000000": {}}}, "4": {"b": [{}, 1, {}]}, "70": {"b": {"9": {}}}}}']
    assert found(spark, recs[:1], ["a[]"]) == [("r0", "", "a/0"), ("r0", "", "a/5000")]
    want = ["a/3/b/2", "a/3/b/1000000000000", "a/4/b/0", "a/4/b/2", "a/70/b/9"]
    assert sorted(x[2] for x in found(spark, recs[1:], ["a[].b[]"])) == sorted(want)


def test_text_encoded_many_times(spark):
    rec = '{"a": [{}]}'
    for _ in range(12):  # each encoding doubles the escapes
        rec = json.dumps(rec)
    assert found(spark, [rec], ["a[]"]) == [("r0", "", "a/0")]


sparse = st.dictionaries(st.integers(0, 30).map(str), st.dictionaries(st.just("b"), st.dictionaries(st.integers(0, 9).map(str), st.just({}), min_size=1), max_size=1), min_size=1, max_size=5)


@settings(max_examples=10, deadline=None)
@given(recs=st.lists(sparse, min_size=1, max_size=6))
def test_sparse_places_against_a_walk(spark, recs):
    want = [(f"r{i}", f"a/{p}", f"a/{p}/b/{q}") for i, r in enumerate(recs) for p, x in r.items() for q in x.get("b", {})]
    assert found(spark, [json.dumps({"a": r}) for r in recs], ["a[].b[]"]) == sorted(want)
