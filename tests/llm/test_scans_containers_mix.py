import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import p07_scans as p7
from lodestone.llm import p08_containers as p8
from lodestone.llm import p09_mix as p9
from lodestone.llm.boost import Boost
from lodestone.llm.tokens import counted


def test_boost_learns_and_bears_one_label():
    r = np.random.default_rng(0)
    x = r.normal(size=(800, 3))
    y = (x[:, 0] > 0.3) & (x[:, 1] < 0.5)
    assert ((Boost().fit(x[:600], y[:600]).probability(x[600:]) > 0.5) == y[600:]).mean() > 0.93
    assert Boost().fit(x, np.zeros(800)).probability(x).max() < 0.01
    assert len(Boost().fit(np.zeros((0, 3)), np.zeros(0)).probability(x)) == 800


@pytest.mark.parametrize("line", ["127", "- 53 -", "Page 71 of 78", "105 / 111", "lO6 / lll", "[l36]", "xiii", "[20]", "133  /  137"])
def test_page_numbers(line):
    assert p7.number_like(line)


@pytest.mark.parametrize("line", ["", "lock is free.", "in 2020 the", "Overview", "of the"])
def test_no_page_numbers(line):
    assert not p7.number_like(line)


def test_broken_words():
    assert p7.broken("a new configura-", "tion change") == ("configura", "tion")
    assert p7.broken("the sup‐", "plier note") == ("sup", "plier")
    assert p7.broken("Tolerance is — no", "more") is None and p7.broken("a -", "b") is None and p7.broken("", "x") is None


def test_misread_words_are_ranked():
    words = "retrieval gateway supplier maintenance window technician refreshes calibration evaluation harness annotates rotates several failed section audit vector".split()
    model = p7.fit_words([(w, 0.01) for w in words])

    def p(read, real):
        n = len(set(p7.grams(read)) & set(p7.grams(real)))
        f = p7._candidate_features(read, real, n, 0.01)
        return 0.0 if f is None else float(model.probability(np.array([f]))[0])

    assert p("failecl", "failed") > 0.5 and p("rotate5", "rotates") > 0.5 and p("ann0tates", "annotates") > 0.5 and p("evaluatiori", "evaluation") > 0.5
    assert p7.edits("xyzzy", "failed") is None and p("window", "vector") < 0.5


def test_scanned_tables(spark, tiny):
    got = p7.p7_found(spark, tiny).toPandas()
    assert set(got.columns) == {"atom_id", "line_no", "noise"} and set(got["noise"]) <= {"furniture", "break", "misread"} and len(got) and not got.duplicated().any()
    assert p7.p7_paragraphs(spark, tiny).count() > 0


def test_scans_of_nothing(spark, tmp_path, tiny):
    for t in ("atoms", "documents"):
        spark.read.parquet(f"{tiny}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert p7.p7_found(spark, str(tmp_path)).count() == 0


def least_bins(sizes, capacity):
    best = len(sizes)
    for assign in itertools.product(range(len(sizes)), repeat=len(sizes)):
        load = {}
        for s, b in zip(sizes, assign, strict=True):
            load[b] = load.get(b, 0) + s
        if max(load.values()) <= capacity:
            best = min(best, len(load))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10), min_size=1, max_size=6))
def test_packing_is_best_on_small_sets(sizes):
    bins = p8.pack(sizes, 10)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 10 for b in bins)
    assert len(bins) == least_bins(sizes, 10)


def test_bin_completion_beats_best_fit():
    sizes = [6, 5, 5, 4, 4, 3, 3] * 3  # 30 tens
    assert len(p8.pack(sizes, 10)) == math.ceil(sum(sizes) / 10) <= len(p8.best_fit(sizes, 10))


def test_containers_hold_every_document_once(spark):
    rows = [(k, int(n)) for k, n in enumerate(np.random.default_rng(1).integers(0, 900, 300))] + [(1000, 5000), (1001, 1024), (1002, None), (None, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens int")
    got = p8.packed(df, "doc_id", "tokens", [("a", 128), ("b", 512)], len(rows), lot=100).toPandas()
    for spec, cap in (("a", 128), ("b", 512)):
        g = got[got.spec_id == spec]
        assert g.groupby("container_id")["tokens"].sum().max() <= cap
        assert g.groupby("doc_id")["tokens"].sum().to_dict() == {k: n for k, n in rows if k is not None and n is not None}
        assert (g[g.doc_id.map(dict(rows)) <= cap].groupby("doc_id").size() == 1).all()
    assert p8.packed(df.limit(0), "doc_id", "tokens", [("a", 128)], 0).count() == 0


def test_counts_by_the_public_tokenizer(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "id int, t string")
    got = {r.id: r.tokens for r in counted(df, "t", ("id",)).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] is None and got[4] > 1


def test_raking_meets_source_targets():
    cells = pd.DataFrame([(s, lang, "t", n) for s, n in (("a", 100), ("b", 1000), ("c", 50)) for lang in ("en", "de")], columns=["source", "lang", "topic", "tokens"])
    targets = pd.DataFrame([("a", 0.4, 3), ("b", 0.4, 1), ("c", 0.1, 4), ("gone", 0.1, 2)], columns=["source", "target_share", "max_repeats"])
    r = p9.rake(cells, targets)
    got = (r["copies"] * r["tokens"]).groupby(r["source"]).sum()
    assert np.allclose(got / got.sum(), [4 / 9, 4 / 9, 1 / 9]) and (r["copies"] <= r["max_repeats"] + 1e-9).all()
    assert len(p9.rake(cells.iloc[:0], targets)) == 0


def test_mix_repeats_within_the_cap(spark):
    r = np.random.default_rng(2)
    rows = [(k, ["a", "b", "c", None][k % 4], ["en", "DE", None][k % 3], ["t", "u"][k % 2], int(r.integers(0, 300)) if k % 50 else None) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, topic string, tokens int")
    targets = spark.createDataFrame([("m", "a", 0.6, 2), ("m", "b", 0.3, 1), ("m", "none", 0.1, 3)], "mix_id string, source string, target_share double, max_repeats int")
    topics = spark.createDataFrame([("t",)], "topic string")
    got = p9.mixed(docs, targets, topics)[0].toPandas()
    share = (got.tokens * got.copies).groupby(got.source).sum() / (got.tokens * got.copies).sum()
    assert abs(share["a"] - 2 / 3) < 0.01 and got[got.source == "a"].copies.max() <= 2 and got[got.source == "b"].copies.max() == 1 and not got.duplicated(["mix_id", "doc_id"]).any()
    assert p9.mixed(docs.limit(0), targets, topics)[0].count() == 0


def test_a_long_document_comes_out_in_one_series(spark, monkeypatch):
    rows = []
    for k in range(40):
        text = [f"page {k} begins a line of text that goes on", f"and is continu-" if k % 3 == 0 else "and ends here"]
        rows.append((7, f"7#{k}", 1 + k, "\n".join([f"{k}", *text])))
    rows += [(7, "7#9999", 1000, "7"), (7, "7#10000", 1001, "ed to the last."), (8, "8#1", 1, "alone")]
    df = spark.createDataFrame(rows, "doc_id bigint, atom_id string, page int, text string")

    def series(window):
        monkeypatch.setattr(p7, "WINDOW", window)
        pages = p7.ordered(df)
        assert [r.atom_id for r in pages.where("doc_id = 7").orderBy("no").collect()] == [r[1] for r in rows[:-1]]
        of = p7._by_window(pages, p7._edges, "doc_id bigint, atom_id string, line int, f array<double>, words array<string>", p7.REACH).collect()
        lines = pages.select("doc_id", "atom_id", "no", p7.F.posexplode(p7.F.split("text", "\n")).alias("line_no", "line"))
        lines = lines.where("NOT line RLIKE '^[0-9]+$'").selectExpr("*", "CAST(NULL AS map<string,string>) AS fix", "CASE WHEN line LIKE '%-' THEN 'continu' END AS part_a", "CAST(NULL AS boolean) AS compound")
        return sorted(map(str, of)), sorted(map(tuple, p7.paragraphs(lines).collect()))

    small, large = series(3), series(64)
    assert small == large
    assert [r[1] for r in small[1]] == [0, 0] and "is continupage 1 begins" in small[1][0][2]


def test_line_pairs_are_judged():
    words = "retrieval gateway supplier maintenance window technician refreshes calibration evaluation harness annotates rotates several failed section audit vector".split()
    model = p7.fit_pairs([("und", 0.5), ("or", 0.5), ("and", 0.4)] + [(w, 0.01) for w in words])
    p = lambda *f: float(model.probability(np.array([p7._pair_features(*f)]))[0])
    assert p("gate", "way", 0.01, 0.0, 0.0, 0.0) > 0.5 and p("calibra", "tion", 0.0, 0.0, 0.0, 0.0) > 0.5 and p("window", "audit", 0.0, 1e-3, 0.01, 0.01) > 0.5
    assert p("lese", "und", 0.0, 0.0, 0.0, 0.5) < 0.5
