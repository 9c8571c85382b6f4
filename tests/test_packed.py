"""Packed fields: each notation, and round trips of values written in it."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from lodestrand.operators.packed import unpack, unpack_fields

CASES = [
    ("['a', \"operator's cab\"]", ["a", "operator's cab"]),
    ('["\\u7194\\u7089", "b; c"]', ["熔炉", "b; c"]),
    ('[阀门，"x, y", z]', ["阀门", "x, y", "z"]),
    ('"24"" pipe"; on/off log', ['24" pipe', "on/off log"]),
    ("hoist\\; manual,hopper,fitter's bench", ["hoist; manual", "hopper", "fitter's bench"]),
    ("a / b、c\td | e\r\nf ；g", ["a", "b", "c", "d", "e", "f", "g"]),
    (";制动片受潮，", ["制动片受潮"]),
    ('\'24" pipe\', \'hoist; spare\'', ['24" pipe', "hoist; spare"]),
    ("a, a,,a", ["a", "a", "a"]),
    ("single", ["single"]), ("[]", []), ("", []), ("  ", []), (";;", []), ("连接销（左）", ["连接销（左）"]),
]


def test_notations(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "i int, c string")
    got = {r["i"]: r["v"] for r in df.select("i", unpack(F.col("c")).alias("v")).collect()}
    assert got == {i: v for i, (_, v) in enumerate(CASES)}


def test_fields(spark):
    df = spark.createDataFrame([("k", "a,b", None, 1), ("k", "a,b", None, 1), (None, "x", "y", 2), ("m", "", "q", 3)], "key string, f string, g string, pos int")
    assert rows(unpack_fields(df, "t", "key", ["f", "g"])) == [("t", "k", "f", 1, "a"), ("t", "k", "f", 2, "b"), ("t", "m", "g", 1, "q")]
    assert unpack_fields(df.limit(0), "t", "key", ["f", "g"]).count() == 0
    long = spark.createDataFrame([("k", ",".join(["v"] * 50_000))], "key string, f string")
    assert unpack_fields(long, "t", "key", ["f"]).count() == 50_000


value = st.text("ab ;,|/'熔 (", min_size=1, max_size=8).map(str.strip).filter(lambda v: v and v != "/" and not v.startswith("'") and not v.endswith("'"))


@settings(max_examples=20, deadline=None)
@given(lists=st.lists(st.lists(value, min_size=1, max_size=5), min_size=1, max_size=20))
def test_round_trip_of_json(spark, lists):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(lists)], "i int, c string")
    got = {r["i"]: r["v"] for r in df.select("i", unpack(F.col("c")).alias("v")).collect()}
    clean = [[v for v in vs if "', '" not in v and '"' not in v] for vs in lists]
    for i, vs in enumerate(clean):
        if all(" '" not in v and "' " not in v and ",'" not in v and "'," not in v and ";'" not in v and "';" not in v and "|'" not in v and "'|" not in v for v in vs):
            assert got[i] == vs


def test_every_character_is_kept_and_any_white_space(spark):
    own = "".join(map(chr, range(0xE000, 0xE100)))
    cases = {f'{own},b': [own, "b"], f'"{own[:3]},{own[3:6]}";x': [own[:3] + "," + own[3:6], "x"], "a," + " " * 60 + '"b,c"' + " " * 70 + ";d": ["a", "b,c", "d"], '"a","b","",c': ["a", "b", "c"], "E010": ["E010"]}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", unpack(F.col("t")).alias("v")).collect()} == cases
