import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import p01_split, p02_quantiles, p03_looks
from lodestone.llm.classes import variant_pairs
from lodestone.operators.ingest import tokens

TEXT = st.text(alphabet=st.sampled_from(list("ab1_` .!?\n，。量ｆé-\t")), max_size=400)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(0, 400), st.integers(0, 400))
def test_slice_counts_equal_the_counter(text, a, b):
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    assert int(p01_split.TokenOffsets(text).count(a, b)) == tokens(text[a:b])


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 40), st.sampled_from([0.0, 0.1, 0.5, None, float("nan")]))
def test_pieces_cover_the_text_within_the_limit(text, limit, ratio):
    pieces = p01_split.split_text(text, limit, ratio)
    covered = 0
    for k, (x, y) in enumerate(pieces):
        assert x < y and x <= covered and y > covered
        assert tokens(text[x:y]) <= limit
        if k:
            budget = int(limit * (0.1 if ratio is None or math.isnan(ratio) else ratio))
            assert tokens(text[x:covered]) <= budget
        covered = y
    assert covered == len(text)


def test_cuts_fall_on_natural_boundaries():
    text = "First sentence here is long enough. Second one follows it now. Third is the last of them."
    pieces = [text[x:y] for x, y in p01_split.split_text(text, 9, 0.0)]
    assert pieces[0].rstrip().endswith(".") and len(pieces) > 1
    assert p01_split.split_text("x" * 10_000, 1, 0.1) == [(0, 10_000)]  # one word is one token
    assert len(p01_split.split_text("量" * 1000, 100, 0.1)) == 11


def test_split_frame_with_nulls_and_other_columns(spark):
    long = "word " * 50
    rows = [("a", long, 20, 0.1, 1), ("b", None, 20, 0.1, 1), (None, long, 20, 0.1, 1), ("c", "", 20, 0.1, 1), ("d", long, None, 0.1, 1), ("e", "short", 20, None, 1), ("f", long, 20, None, 1)]
    df = spark.createDataFrame(rows, "id string, text string, m int, o double, piece int")
    got = p01_split.split_oversized(df, "id", "text", "m", "o").collect()
    assert {r.id for r in got} == {"a", "f"} and all(r.piece_tokens <= 20 for r in got)
    assert p01_split.split_oversized(df.limit(0), "id", "text", "m", "o").count() == 0


@pytest.mark.parametrize("kind", ["normal", "ties", "sorted", "heavy"])
def test_sketch_keeps_its_bound_after_merges(kind):
    r = np.random.default_rng(1)
    x = {"normal": r.normal(1e4, 300, 60_000), "ties": r.integers(0, 9, 60_000).astype(float), "sorted": np.arange(60_000.0), "heavy": r.pareto(0.7, 60_000)}[kind]
    s = p02_quantiles.RankSketch()
    for part in np.array_split(x, 23):
        s.merge(p02_quantiles.RankSketch.from_bytes(p02_quantiles.RankSketch().add(part).to_bytes()))
    assert s.n == len(x) == sum(len(v) << h for h, v in enumerate(s.levels))
    y = np.sort(x)
    for q, v in zip(p02_quantiles.PERCENTS, s.quantiles(p02_quantiles.PERCENTS), strict=True):
        lo, hi = np.searchsorted(y, v, "left") / len(y), np.searchsorted(y, v, "right") / len(y)
        assert max(0, lo - q, q - hi) <= s.bound(q) + 1 / len(y)


def test_sketch_of_little_is_exact():
    s = p02_quantiles.RankSketch().add(np.array([3.0, 1.0, np.nan, 2.0]))
    assert s.quantiles((0.0, 0.5, 1.0)) == [1.0, 2.0, 3.0] and s.bound(0.5) == 0
    assert math.isnan(p02_quantiles.RankSketch().quantiles((0.5,))[0])


def test_sketch_frame_leaves_out_nulls_and_negatives(spark):
    rows = [("m", None, 5, None), ("m", None, -1, 3), ("m", None, None, 4), (None, "k", 7, 7)]
    df = spark.createDataFrame(rows, "model string, kb string, a int, b int")
    keys = ["model", "kb"]
    got = {(r.model, r.kb, r.field): (r.n, r.value) for r in p02_quantiles.percentiles(p02_quantiles.merged(p02_quantiles.sketches(df, keys, ["a", "b"]), keys), keys, (0.5,)).collect()}
    assert got == {("m", None, "a"): (1, 5.0), ("m", None, "b"): (2, 3.0), (None, "k", "a"): (1, 7.0), (None, "k", "b"): (1, 7.0)}
    assert p02_quantiles.merged(p02_quantiles.sketches(df.limit(0), keys, ["a"]), keys).count() == 0


SAME = [
    ("ＡＢＣ１２", "ABC12"), ("café", "café"), ("a​b­", "ab"), ("a b c", "a b c"), ("well‐known‑x", "well-known-x"), ("ﬁle oﬃce", "file office"),
    ("раураl", "paypal"), ("Αthens", "Athens"), ("更料", "更料"), ("⼊⽤", "入用"), ("ё", "ё"), ("𝐀𝑏", "Ab"), ("й", "й"), ("ｅ́", "é"),
]
DIFFERENT = [("Cafe", "café"), ("abc", "Abc"), ("file1", "file2"), ("a b", "a  b"), ("a-b", "a–b"), ("x²", "x2"), ("O", "0"), ("l", "1"), ("ab", "a b"), ("文", "交")]


@pytest.mark.parametrize("a, b", SAME)
def test_same_look_same_form(a, b):
    assert p03_looks.one_form(a) == p03_looks.one_form(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_other_look_other_form(a, b):
    assert p03_looks.one_form(a) != p03_looks.one_form(b)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_form_is_idempotent(s):
    assert p03_looks.one_form(p03_looks.one_form(s)) == p03_looks.one_form(s)


def test_mapping_has_no_conflict():
    to = p03_looks.mapping()
    assert len(to) > 1000 and not any(x in to for v in to.values() for x in v)


def test_pairs_of_looks(spark):
    rows = [("t", "1", "café", 0), ("t", "2", "café", 0), ("t", "2", "café", 0), ("t", "3", "café", 0), ("t", "4", None, 0), ("t", "5", "", 0), ("u", "6", "café", 0)]
    df = spark.createDataFrame(rows, "tbl string, key string, text string, variant int")
    got = {tuple(r) for r in variant_pairs(p03_looks.look_classes(df, "text", ("tbl", "key"))).collect()}
    assert got == {("t", "1", "2"), ("t", "2", "3")}
    assert variant_pairs(p03_looks.look_classes(df.limit(0), "text", ("tbl", "key"))).count() == 0


def test_every_two_variants_of_a_hot_class_are_paired(spark):
    few = [("t", f"{k:05d}", "c", k % 3) for k in range(101)]
    many = [("u", f"{k:05d}", "c", k) for k in range(300)]
    twice = [("v", "0", "c", 1), ("v", "0", "c", 2), ("v", "1", "c", 2), *(("v", f"x{k:03d}", "c", 3) for k in range(100))]
    df = spark.createDataFrame(few + many + twice, "tbl string, key string, cls string, variant bigint")
    for blocks in ({}, {"block": 40}):
        got = [tuple(r) for r in variant_pairs(df, **blocks).collect()]
        assert len(got) == len(set(got)) and all(a < b for _, a, b in got)
        assert {frozenset((int(a) % 3, int(b) % 3)) for t, a, b in got if t == "t"} == {frozenset(x) for x in ((0, 1), (0, 2), (1, 2))}
        assert {k for t, *p in got if t == "t" for k in p} == {x[1] for x in few}
        assert len([x for x in got if x[0] == "u"]) == 300 * 299 // 2
        assert ("v", "0", "1") in got


def test_hot_class_comes_out_linear_and_whole(spark):
    rows = [("t", f"{k:05d}", "ab" if k % 3 else "a​b") for k in range(900)]
    df = spark.createDataFrame(rows, "tbl string, key string, text string")
    got = variant_pairs(p03_looks.look_classes(df, "text", ("tbl", "key"))).collect()
    assert len(got) < 1000 and {k for r in got for k in (r.key_a, r.key_b)} == {f"{k:05d}" for k in range(900)}
    text = {k: t for _, k, t in rows}
    assert all(text[r.key_a] != text[r.key_b] for r in got)
