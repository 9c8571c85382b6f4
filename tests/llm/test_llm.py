"""Operators for training data: fixtures, brute force and edge cases."""

from __future__ import annotations

import os
import unicodedata as ud

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import sentence_oracle

from lodestrand.llm import canonical, lookalike, packing, pieces, sentences, splits, tokens, truncation

needs_vocabulary = pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.tiktoken"), reason="no vocabulary files")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- splits


def brute_components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in parent)


@settings(max_examples=8, deadline=None)
@given(pairs=st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, pairs):
    named = [(f"{a:02}", f"{b:02}") for a, b in pairs if a != b]
    df = spark.createDataFrame(named, "a string, b string")
    assert rows(splits.components(df).select("node", "root")) == brute_components(named)


def test_component_of_a_long_chain(spark):
    df = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(200)], "a string, b string")
    assert {r["root"] for r in splits.components(df).collect()} == {"000"}


def test_splits_are_kept_and_conflicts_quarantined(spark):
    docs = spark.createDataFrame([(f"d{i:03}", 1) for i in range(300)], "doc_id string, w int")
    links = spark.createDataFrame([(f"d{i:03}", f"g{i // 3}") for i in range(300)] + [("d000", None), (None, "g1")], "doc_id string, group_id string")
    first = splits.update(splits.empty_state(spark), docs, links)
    one = {r["doc_id"]: r for r in first.collect()}
    assert len(one) == 300 and all(one[f"d{3 * i:03}"]["split"] == one[f"d{3 * i + 2:03}"]["split"] for i in range(100))
    share = {s: sum(r["split"] == s for r in one.values()) / 300 for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.03 and share["validation"] > 0.05 and share["test"] > 0.05
    train = min(d for d, r in one.items() if r["split"] == "train")
    test = min(d for d, r in one.items() if r["split"] == "test")
    more = spark.createDataFrame([(train, "new"), (test, "new"), ("e1", "h"), ("e2", "h")], "doc_id string, group_id string")
    two = {r["doc_id"]: r for r in splits.update(first, spark.createDataFrame([("e1", 1), ("e2", 1)], "doc_id string, w int"), links.unionByName(more)).collect()}
    hurt = {one[train]["comp"], one[test]["comp"]}
    for d, r in one.items():
        assert two[d]["split"] == ("quarantine" if r["comp"] in hurt else r["split"])
    assert two["e1"]["split"] == two["e2"]["split"] and two["e1"]["comp"] == "e1"


def test_store_of_splits(spark, tmp_path):
    s = splits.Store(spark, str(tmp_path / "state"))
    d = spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, w int")
    m = spark.createDataFrame([("a", "g"), ("b", "g")], "doc_id string, group_id string")
    assert s.load().count() == 0
    assert rows(s.apply(d, m).select("doc_id", "comp")) == [("a", "a"), ("b", "a")]
    assert rows(s.apply(d, m).select("doc_id", "w")) == [("a", 2), ("b", 2)] and s._versions() == [1, 2]


def test_empty_batch(spark):
    none = spark.createDataFrame([], "doc_id string, w int")
    assert splits.update(splits.empty_state(spark), none, spark.createDataFrame([], "doc_id string, group_id string")).count() == 0
    c = spark.createDataFrame([(" Twin::A ",), ("NaN",), ("",), (None,), ("-",)], "g string")
    assert [r[0] for r in c.select(splits.clean_group("g")).collect()] == ["twin::a", None, None, None, None]


# --- canonical names

LIST = [("竹纤维低温仓储", "A1"), ("木炭烧结成型", "A2"), ("Sea salt bulk haulage", "B1"), ("Peat block pressing and laminating", "B2"), ("Peat block press works; coastal", "B2"), ("shared", "C1"), ("shared", "C2")]
NAMES = {
    "专业竹纤维低温仓储公司。": "A1", "低温仓储（竹纤维）": "A1", "竹纤维的低温仓储": "A1", "竹纖維低温倉儲": "A1", "竹纤唯低温仓储": "A1", "竹 纤 维 低 温 仓 储": "A1",
    "木炭燒結成型\n": "A2", "sea-salt-bulk-haulage": "B1", "Ｓｅａ ｓａｌｔ ｂｕｌｋ ｈａｕｌａｇｅ": "B1", "bulk haulage of sea salts": "B1", "Sea salt bulk haul.": "B1", "sae salt bulk haulagee": "B1", "bulk haulage, Sea salt (U8111)": "B1",
    "Peat block pressing & lam.": "B2", "peat block press works coastal ltd": "B2", "sea salt tasting evening": "", "软木画展": "", "": "", "  ": "", "n/a": "", "??": "", "shared": "",
}


NOISE = ["专业", "公司", "的", "ltd", "of"]


def test_names(spark):
    simple, radical = canonical.simplified(spark), canonical.radicals(spark)
    m = canonical.Matcher(LIST, NOISE, simple, radical)
    assert {n: m.decide(n)[0] for n in NAMES} == NAMES
    assert m.decide(None) == ("", "filler") and m.decide("x" * 20_000)[0] == "" and canonical.Matcher([]).decide("abc") == ("", "none")
    assert radical["本"] == radical["木"] != radical["泥"] and simple[ord("倉")] == "仓"


def test_mentions_are_words_and_two_of_them_are_ambiguous():
    m = canonical.Matcher([("Ice", "A1"), ("Tea", "B1"), ("Coal mining", "C1"), ("tea trade", "B1"), ("木炭", "D1"), ("木炭烧结", "D2")])
    want = {"rice milling": ("", "none"), "office work": ("", "none"), "ice": ("A1", "mention"), "Tea growing and Coal mining": ("", "ambiguous"), "tea trade, tea": ("B1", "mention"), "大木炭烧结厂": ("D2", "mention")}
    assert {v: m.decide(v) for v in want} == want


def test_every_near_entry_is_compared():
    """Entries that share more tokens with a value than the right one cannot push it out: the nearest equals brute force."""
    rng = np.random.default_rng(3)
    names = sorted({"".join(rng.choice(list("abcdefg"), rng.integers(8, 20))) for _ in range(300)})
    m = canonical.Matcher([(n, f"c{i}") for i, n in enumerate(names)])
    for n in names[:80]:
        at = int(rng.integers(1, len(n) - 1))
        value = n[:at] + "z" + n[at + 1 :]
        d = {c: canonical.edits(value, x, canonical._limit(x)) for x, c in zip(m.keys, m.codes)}
        near = {c: v for (c, v), x in zip(d.items(), m.keys) if v <= canonical._limit(x)}
        least = {c for c, v in near.items() if v == min(near.values())}
        if not m.mentioned(value):
            assert m.similar(value) == least


def test_map_values(spark):
    df = spark.createDataFrame([(1, "木炭烧结成型", "x"), (1, "木炭烧结成型", "x"), (2, None, "y"), (None, "木炭烧结成型", "z")], "entry_id int, name string, full_code string")
    assert rows(canonical.map_values(df, "entry_id", "name", LIST)) == [(1, "A2"), (2, "")]
    assert canonical.map_values(df.limit(0), "entry_id", "name", LIST).count() == 0
    with pytest.raises(ValueError):
        canonical.map_values(df, "entry_id", "name", [("a", "b")] * (canonical.MAX_ENTRIES + 1))


def test_edits():
    assert [canonical.edits("abcd", x, 2) for x in ("abcd", "abdc", "abd", "axcdx", "zzzz")] == [0, 1, 1, 2, 3]


# --- pieces


def check_pieces(text, got, limit, overlap):
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b, t), nxt in zip(got, [*got[1:], None]):
        assert t == text[a:b] and 0 < b - a <= limit
        if nxt:
            assert b - overlap <= nxt[0] < b < nxt[1]


def test_pieces(spark):
    texts = {"words": "word and word. " * 60, "run": "x" * 500, "mixed": "句子一。" * 20 + "y" * 300 + "。尾", "short": "a" * 100, "blank": " " * 400, "null": None, "newlines": "line one\n" * 40, "emoji": "🙂" * 250}
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in texts.items()], "k string, t string, pos int, rank int")
    got = {}
    for r in pieces.split_texts(df, "k", "t", 100, 10).orderBy("k", "piece").collect():
        got.setdefault(r["k"], []).append((r["start_char"], r["end_char"], r["text"], r["forced"]))
    assert set(got) == {"words", "run", "mixed", "newlines", "emoji"}
    for k, v in got.items():
        check_pieces(texts[k], [x[:3] for x in v], 100, 10)
    assert {k: v[0][3] for k, v in got.items()} == {"words": 0, "run": 1, "mixed": 1, "newlines": 0, "emoji": 1}
    assert all(t.endswith(("\n",)) for *_, t, _ in got["newlines"])
    assert pieces.split_texts(df.limit(0), "k", "t").count() == 0


@settings(max_examples=6, deadline=None)
@given(texts=st.lists(st.text("ab .。\n", min_size=0, max_size=300), min_size=1, max_size=8))
def test_pieces_cover_any_text(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = {}
    for r in pieces.split_texts(df, "k", "t", 40, 8).orderBy("k", "piece").collect():
        got.setdefault(r["k"], []).append((r["start_char"], r["end_char"], r["text"]))
    assert set(got) == {i for i, t in enumerate(texts) if len(t) > 40 and t.strip()}
    for k, v in got.items():
        check_pieces(texts[k], v, 40, 8)


# --- look-alike texts


def test_forms(spark):
    same = [("ＫＯ－１ café", "KO-1 café"), ("К​О‑1", "KO-1"), ("⼆号面", "二号面"), ("a b　c", "a b c"), ("25℃ ㎡", "25°C m²"), ("ệ", "ệ"), ("한", "한"), ("…", "..."), ("νérin", "vérin"), ("e\u0316\u0301", "é\u0316"), ("ｶﾞ", "ガ"), ("\u0e01\u0e49\u200b\u0e38", "\u0e01\u0e38\u0e49")]
    other = [("B²", "B2"), ("①", "1"), ("cafe", "café"), ("Abc", "abc"), ("a\nb", "a b"), ("ԱUSᏔ", "aUSW"), ("насос", "hacoc")]
    texts = sorted({x for p in same + other for x in p})
    df = spark.createDataFrame([(t, "x", "y") for t in texts] + [(None, "x", "y"), ("", "x", "y")], "text string, k string, form string")
    f = {r["text"]: r["form"] for r in lookalike.forms(df, "text").collect()}
    assert set(f) == set(texts) | {""} and f[""] == ""
    for a, b in same:
        assert f[a] == f[b], (a, b)
    for a, b in other:
        assert f[a] != f[b], (a, b)
    assert f["νérin"] == f["vérin"] and f["ԱUSᏔ"] != f["aUSW"]


@settings(max_examples=5, deadline=None)
@given(texts=st.lists(st.text(st.characters(codec="utf-8", categories=("L", "M", "N", "P", "Z")), max_size=30), min_size=1, max_size=20))
def test_forms_of_normal_forms_agree(spark, texts):
    both = sorted({ud.normalize(f, t) for t in texts for f in ("NFC", "NFD")})
    f = {r["text"]: r["form"] for r in lookalike.forms(spark.createDataFrame([(t,) for t in both], "text string"), "text").collect()}
    for t in texts:
        assert f[ud.normalize("NFC", t)] == f[ud.normalize("NFD", t)]


def test_pairs(spark):
    df = spark.createDataFrame([("a", "Тур"), ("b", "Typ"), ("c", "Typ"), ("c", "Typ"), ("d", "typ"), ("e", None), (None, "Typ"), ("f", "")], "key string, text string")
    assert rows(lookalike.alike_pairs(df, "key", "text")) == [("a", "b"), ("a", "c")]
    long = spark.createDataFrame([("a", "ｘ" * 3000), ("b", "x" * 3000)], "key string, text string")
    assert rows(lookalike.alike_pairs(long, "key", "text")) == [("a", "b")]
    assert lookalike.alike_pairs(df.limit(0), "key", "text").count() == 0


# --- sentences

TEXTS = {
    "Nobody stood there! See Fig. 2 and Sec. 3.4 for it. It left at 5.30 p.m. and came back. It rang at 5 p.m. Then all stopped.": 5,
    'He said: "I heard a crack. Then I saw smoke." The fan ran on... then it stalled.': 2,
    '"Stop! It is jammed," he called out. Is it "on? off?" and then gone.': 2,
    "They checked pins etc.Nobody left. Crew No. 4 found it; crew No. 5 did not.": 3,
    "Am 21. August fiel es aus. Gegen 7.28 Uhr, d. h. ca. 3 bar, vgl. Abb. 5. Die Folge war z. B. Brand. „Halt! Es klemmt“, rief er.": 4,
    "« Arrêtez tout ! Ça coince », a crié le grutier. Le bon n° 4 (réf. A-1) n’était pas signé, cf. p. 3. La cause est ici ?": 3,
    "班长说：“声音不对。先别靠近！”随后他离开了。“门是谁打开的？”班长反复询问。由Tarn & Brill Ltd.提供。在No. 4工位发现。": 4,
    "司机大喊：“快停下！”调度员撤离。为什么？": 3,
    "班長は「おかしい。離れろ！」と叫んだ。圧力は3.5MPaで超えていた。": 2,
    'चालक ने कहा, "रुको। पास मत आओ!" और गया। मशीन क्यों नहीं रुकी?': 2,
    "第2节 概况\n\n1) 更换\n2) 检查\n\n没有围挡。由于磨\n损停止。": 5,
    "没有设置围挡 设备停机 22名工人在场\n另查明，曾报警": 4,
    "ควากำหนด\nใบตรวจ หลังจาก": 3,
    "": 0, "  \n ": 0, "ABC123" * 40: 1, "cut off in the": 1,
}


@pytest.mark.parametrize("text", list(TEXTS))
def test_sentence_counts(text):
    spans = sentence_oracle.spans(text)
    assert len(spans) == TEXTS[text], [text[a:b] for a, b in spans]
    assert all(text[a:b] == text[a:b].strip() for a, b in spans)


def test_sentences_equal_the_sequential_reader_whatever_the_segment(spark):
    """Every column, kind included, of texts of many shapes, with segments of one event, of a few, and longer than any text."""
    rng = np.random.default_rng(7)
    parts = [t for t in TEXTS if t.strip()] + ["1. one\n2. two", "12. Mai war es", "- item one\n- item two", "\n\n", "\n", " ", "(一) 概况", "“", "”", '"', "A'b c", "3.5", "e.g.", "\0"]
    texts = ["".join(p + rng.choice(["\n\n", "\n", " ", ""]) for p in rng.choice(parts, rng.integers(1, 12))) for _ in range(150)] + [None, "", " \n ", ("".join(list(TEXTS)[:6]) + "\n\n") * 60]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "A b.", "x")], "k int, t string, id string")
    want = sorted((i, s, e, sentences.kind_of(t[s:e], sentences._alone(t, s, e)), t[s:e]) for i, t in enumerate(texts) if t for s, e in sentence_oracle.spans(t.replace("\0", "\ufffd")))
    for segment in (1, 7, 1 << 20):
        assert rows(sentences.split_sentences(df, "k", "t", segment)) == want
    assert sentences.sentence_spans(df.limit(0), "k", "t").count() == 0


def test_functions_compose():
    text = list(TEXTS)[6] * 3
    _, cls, *_ = sentences.lex([text])
    whole = sentences.functions(cls, np.array([0, len(cls)]))[0]
    for at in range(1, len(cls)):
        a, b = sentences.functions(cls, np.array([0, at, len(cls)]))
        assert list(b[a]) == list(whole)


# --- tokens and containers


@needs_vocabulary
def test_ids_equal_the_public_encoders(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["", None, "   ", "<|endoftext|> a", "Hello  world\n\n你好，世界 🙂 ก็", "#" * 3000, "ab" * 1000, "a" * 257, "x y\x1c\x85z", "é́"]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id int, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df, "doc_id", "text").collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


@needs_vocabulary
@settings(max_examples=30, deadline=None)
@given(texts=st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_ids_of_any_text(texts):
    import tiktoken

    bpe = tokens.load("/opt/tokenizers/byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S").replace(r"[^\s\p{L}\p{N}]", r"[^\s\p{L}\p{N}]"), mergeable_ranks=bpe.ranks, special_tokens={})
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    flat, at = bpe.encode(texts)
    assert [list(flat[at[i] : at[i + 1]]) for i in range(len(texts))] == [enc.encode_ordinary(t) for t in texts]


def test_pair_table():
    table = tokens.PairTable({b"a": 0, b"b": 1, b"ab": 2, b"aba": 3})
    assert list(table(np.array([0, 2, 1, -1]), np.array([1, 0, 1, 0]))) == [2, 3, tokens.NONE, tokens.NONE]


def test_packing(spark):
    rng = np.random.default_rng(1)
    sizes = [0, 5, 100, 101, 250, 300, *rng.integers(1, 60, 400).tolist()]
    docs = [(i, rng.integers(0, 50, n).tolist(), i) for i, n in enumerate(sizes)] + [(998, None, 1), (None, [1], 1)]
    df = spark.createDataFrame(docs, "doc_id int, ids array<int>, size int")
    got = packing.pack(df, "doc_id", "ids", 100, shard_items=60).toPandas()
    assert set(got["doc_id"]) == {*range(len(sizes)), 998}
    per = got.groupby("doc_id").agg(n=("part", "size"), total=("size", "sum"))
    assert all(per["total"][i] == n and per["n"][i] == max(1, -(-n // 100)) for i, n in enumerate(sizes))
    fill = got.groupby("container")["size"].sum()
    assert fill.max() <= 100 and sum(sizes) / (len(fill) * 100) > 0.97
    assert packing.pack(df.limit(0), "doc_id", "ids", 100).count() == 0
    only = packing.pack(spark.createDataFrame([(1, [])], "doc_id int, ids array<int>"), "doc_id", "ids", 10).collect()
    assert len(only) == 1 and only[0]["size"] == 0


def test_neighbours_share_words():
    index = packing.Bm25([np.array(x) for x in ([1, 2, 3], [1, 2, 9], [7, 8], [3, 3, 3])])
    found = index.neighbours(0, np.array([False, True, True, True]))
    assert set(found) == {1, 3} and 2 not in found


# --- cut texts


def test_cut_texts(spark):
    whole = ["The pump at hall B failed because of rust.", "Nobody stood near the old dock.", "The fitter closed the valve at 5 p.m.", "See Fig. 3 for the layout of hall B."]
    docs = [(i, "en", " ".join(whole[(i + j) % 4] for j in range(3)) + "\n\n" + whole[i % 4]) for i in range(40)]
    cases = [(100, "en", whole[0] + " Nobody stood near the ol"), (101, "en", whole[1] + " See Fig."), (102, "en", whole[1] + " The pump at hall B fai&am"), (103, None, whole[2] + " Nobody stood [more]"), (104, "en", None), (105, "en", "  "), (106, "EN-gb", whole[3] + " " + whole[0]), (107, "en", whole[0] + " The fitter closed…")]
    df = spark.createDataFrame([(k, g, t, 1, 2) for k, g, t in docs + cases], "doc_id int, lang string, text string, h int, t int")
    got = {r["doc_id"]: r["cut"] for r in truncation.detect(df, "doc_id", "text").collect()}
    assert {k for k, v in got.items() if v} == {100, 101, 102, 103, 107}
    assert 104 not in got and 105 not in got and got[106] is False
    assert truncation.detect(df.limit(0), "doc_id", "text").count() == 0


def test_tail_lines_that_recur_are_complete(spark):
    docs = [(i, "en", f"The pump failed on day {i}. It was closed.\n\nPrepared by: the fitter") for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id int, lang string, text string")
    assert not any(r["cut"] for r in truncation.detect(df, "doc_id", "text").collect())


# --- queries


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p4_found", "p6_found", "p7_found", "p8_ids", "p9_found", "p10_found", "p1_incremental", "p4_pieces", "p9_fill", "p10_sources"])
def test_queries(spark, small, name):
    from lodestrand.llm.queries import QUERIES

    want = {"p1_found": ["doc_a", "doc_b"], "p2_found": ["entry_id", "full_code"], "p4_found": ["evidence_id", "forced"], "p6_found": ["key_a", "key_b"], "p7_found": ["evidence_id", "start_char", "end_char"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id"], "p10_found": ["doc_id"]}
    df = QUERIES[name](spark, small)
    assert df.columns == want.get(name, df.columns)
    assert df.count() >= 0
    if name.endswith("_found"):
        assert df.count() == df.distinct().count()


@pytest.mark.parametrize("name", ["p1_found", "p4_found"])
def test_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    from lodestrand.llm.queries import QUERIES, SQL

    c = duckdb.connect()
    for t in ("evidence_chunks", "pseudo_multitask_labels"):
        c.execute(f"create view {t} as from '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    assert rows(df) == sorted(tuple(r) for r in c.execute(SQL[name]).df()[df.columns].itertuples(index=False))
    _ = F
