import numpy as np
import pytest

from lodestone.llm import p04_neighbours as p4
from lodestone.llm import p06_near as p6
from lodestone.llm import p10_encoding as p10


def vectors(spark, n=600, seed=0):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(n // 6, 64))
    x = np.concatenate([centre + 0.25 * r.normal(size=centre.shape) for _ in range(6)])
    rows = [(f"c{k:04d}", 1, [float(v) for v in x[k] * (k % 3 + 1)]) for k in range(len(x))]
    extra = [("z1", 1, None), ("z2", 1, [0.0] * 64), ("z3", 1, [1.0] * 32), ("z4", 1, [float("nan")] * 64), (None, 1, [1.0] * 64), ("c0000", 0, [1.0] * 64), ("z5", 2, None), ("z5", 1, [1.0] * 64), rows[5]]
    return x, spark.createDataFrame(rows + extra, "key string, version int, v array<double>")


def test_graph_finds_nearly_all_neighbours(spark):
    x, df = vectors(spark)
    n = p4.nodes(df, "key", "v", "version")
    assert n.count() == len(x)
    got = p4.nearest(n, p4.neighbour_graph(n, trees=4, leaf=128, rounds=2), 10)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = {(f"c{i:04d}", f"c{j:04d}") for i in range(len(x)) for j in np.argsort(-s[i])[:10]}
    found = {(r.key_a, r.key_b) for r in got.collect()}
    assert len(true & found) / len(true) >= 0.9


def test_identical_vectors_and_few(spark):
    rows = [(f"k{i:03d}", 1, [1.0] + [0.0] * 63) for i in range(300)]
    n = p4.nodes(spark.createDataFrame(rows, "key string, version int, v array<double>"), "key", "v", "version")
    got = p4.nearest(n, p4.neighbour_graph(n, trees=2, leaf=64, rounds=1), 10, 0.85).collect()
    assert {r.key_a for r in got} == {r[0] for r in rows} and all(r.cosine > 0.999 for r in got)
    none = p4.nodes(spark.createDataFrame([], "key string, version int, v array<double>"), "key", "v", "version")
    assert p4.nearest(none, p4.neighbour_graph(none, trees=1, rounds=1), 10).count() == 0


def test_greedy_search_walks_to_the_nearest(spark):
    x, _ = vectors(spark, 300)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    edges = {i: [int(j) for j in np.argsort(-s[i])[:12]]  for i in range(len(x))}
    edges = {i: sorted({*edges[i], *(j for j in edges if i in edges[j])}) for i in edges}  # walked both ways
    hit = sum(p4.greedy_search(u[i], dict(enumerate(u)), edges, list(range(5, len(x), 10)), 1, 64)[0] == i for i in range(0, len(x), 20))
    assert hit >= 0.9 * len(range(0, len(x), 20))


BASE = "The loading dock measures the shared glossary until the mirror has caught up while the torque wrench station rebuilds the weekly digest, and the field technician refreshes the supplier note number "


def brute(texts):
    sets = {k: {t.lower().translate({32: None, 9: None, 10: None, 13: None})[i : i + 12] for i in range(len(p6.normalised(t)) - 11)} for k, t in texts.items()}
    ks = sorted(sets)
    return {(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}


def near(spark, texts, tbl="t"):
    df = spark.createDataFrame([(tbl, k, t, 1) for k, t in texts.items()], "tbl string, key string, text string, cls int")
    links, members = p6.near_links(df, "key", "text", "tbl")
    return {(r.key_a, r.key_b) for r in p6.linked_pairs(links.select("cls_a", "cls_b"), members).collect()}


def test_near_duplicates_against_brute_force(spark):
    r = np.random.default_rng(3)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ster", "gon", "dal", "wick", "rum", "ton")]
    texts = {}
    for k in range(60):
        own = " ".join(r.choice(words, 40))
        texts[f"{k:03d}a"] = own
        texts[f"{k:03d}b"] = own.replace(words[k % 30], "changed", 1).upper()
        texts[f"{k:03d}c"] = "\n".join(own.split(" ")[5:] + ["appendix"])
    true, got = brute(texts), near(spark, texts)
    assert got <= true and len(got) >= 0.97 * len(true)


def test_near_edges(spark):
    texts = {"a": BASE + "1", "b": BASE.upper() + "1", "c": BASE + "1", "d": "too short", "e": None, "f": "", "g": "abcdefghij" * 300, "h": "abcdefghij" * 300 + "y", "i": " " * 500}
    got = near(spark, texts)
    assert {("a", "b"), ("a", "c"), ("b", "c"), ("g", "h")} <= got and not any("d" in p or "e" in p or "f" in p for p in got)
    empty = spark.createDataFrame([], "tbl string, key string, text string")
    links, members = p6.near_links(empty, "key", "text", "tbl")
    assert links.count() == 0 and members.count() == 0


def test_hot_copies_stay_linear(spark):
    texts = {f"{k:04d}": BASE + "7" for k in range(400)} | {"zz": BASE + "8 or 9"}
    got = near(spark, texts)
    assert len(got) < 500 and {k for p in got for k in p} == set(texts)


def edits(n, seed=5):
    r = np.random.default_rng(seed)
    own = [f"w{v}" for v in r.integers(10**5, 10**6, 60)]
    texts = {}
    for k in range(n):
        t = list(own)
        for at in r.choice(60, 2, replace=False):
            t[at] = f"x{r.integers(10**5, 10**6)}"
        texts[f"{k:04d}"] = " ".join(t)
    return texts


def test_a_large_family_of_edited_copies_is_linked_throughout(spark):
    texts = edits(300) | {f"z{k}": t for k, t in edits(5, 9).items()}
    true, got = brute(texts), near(spark, texts)
    assert len(true) > 40_000 and got <= true and len(got) >= 0.99 * len(true), (len(true), len(got))


def test_parts_of_a_hot_cell_all_meet(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 9, (4, 64), dtype=np.uint8)
    sig = np.stack([np.where(r.random(64) < 0.8, base[k % 4], r.integers(0, 9, 64)).astype(np.uint8) for k in range(250)])
    members = spark.createDataFrame([(7, k) for k in range(250)] + [(8, k) for k in range(3)], "cell bigint, cls bigint")
    sigs = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sig)], "cls bigint, sig binary")
    true = {(a, b) for a in range(250) for b in range(a + 1, 250) if p6.manhattan(sig[a], sig[b]) <= p6.RADIUS}
    assert 0 < len(true) < 250 * 249 // 2
    for part in (20, 1000):
        assert {tuple(sorted(x)) for x in p6.hot_pairs(members, sigs, part).collect()} == true
    every = spark.createDataFrame([(a, b) for a in range(250) for b in range(a + 1, 250)], "cls_a bigint, cls_b bigint")
    assert {tuple(x) for x in p6.near(every, sigs).collect()} == true


def test_manhattan_is_a_lower_bound():
    r = np.random.default_rng(0)
    a, b = (r.integers(0, 2**32, (500, 64), dtype=np.uint32) for _ in range(2))
    b = np.where(r.random(a.shape) < 0.6, a, b)
    bits = np.array([[int(v).bit_count() for v in x] for x in p6.fingerprint(a) ^ p6.fingerprint(b)]).sum(axis=1)
    d = p6.manhattan(p6.embedded(a), p6.embedded(b))
    assert (d <= bits).all() and (d <= p6.RADIUS).mean() > 0.99
    assert p6.recall(0.8) > 0.999 and p6.recall(0.6) > 0.85 and p6.sieve_loss(0.6) < 3e-4


def test_groups_are_whole_and_name_every_member(spark, tmp_path):
    docs = [(k, t) for k, t in enumerate([*edits(120).values(), *edits(3, 9).values(), "alone " * 40])] + [(500, BASE + "1"), (501, BASE + "1"), (502, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("c1", BASE + "1")], "chunk_id string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r.key: r for r in p6.p6_groups(spark, str(tmp_path)).collect()}
    assert set(got) == {str(k) for k in (*range(123), 500, 501)}
    assert len({got[str(k)].group_id for k in range(120)}) == 1 and len({r.group_id for r in got.values()}) == 3
    assert got["500"].rep == "500" and got["500"].copies == 2 and got["500"].n_links == 0 and got["0"].n_links > 10


CLEAN = {
    "fr": ["L’atelier de mesure rejette les sections modifiées à la fin du mois, après chaque mise à jour.", "La clé d’accès protège l’ancien relevé pendant la période d’entretien."],
    "de": ["Die Flächenheizung überprüft jede Tabellenüberschrift während der Wartung.", "Der Lagerführer löscht die ältesten Einträge gemäß der neuen Richtlinie."],
    "ru": ["Поисковый шлюз сохраняет общий словарь, линия упаковки пропускает подпись к рисунку.", "Как правило, журнал проверок помечает схему проводки до начала утренней смены."],
    "zh": ["季度复盘期间，培训资料为稳妥起见汇总参考图纸。", "没有人工确认时，检索网关一般来说抽查重要度排行，并更新维护窗口。"],
}


@pytest.fixture(scope="module")
def langs():
    return p10.Languages(p10.train({k: [x + f" {i}." for i in range(60) for x in v] for k, v in CLEAN.items()}))


@pytest.mark.parametrize(
    "lang, read_as, really",
    [("fr", "cp1252", "utf-8"), ("fr", "cp437", "utf-8"), ("fr", "mac_roman", "utf-8"), ("de", "cp850", "cp1252"), ("de", "latin-1", "utf-8"), ("ru", "latin-1", "utf-8"), ("ru", "cp1251", "koi8-r"), ("ru", "latin-1", "cp1251"), ("zh", "latin-1", "gb18030"), ("zh", "latin-1", "utf-8")],
)
def test_wrong_decodings_are_undone(langs, lang, read_as, really):
    for s in CLEAN[lang]:
        try:
            bad = s.replace("’", "'").encode(really).decode(read_as)
        except UnicodeError:
            pytest.skip("not expressible")
        new, chains, garbled = p10.restore(bad, langs)
        assert garbled and chains and new == s.replace("’", "'")


def test_twice_wrong_and_partly_wrong(langs):
    s = CLEAN["de"][0]
    twice = s.encode().decode("latin-1").encode().decode("latin-1")
    assert p10.restore(twice, langs)[0] == s
    mixed = s + "\n" + CLEAN["de"][1].encode().decode("latin-1")
    assert p10.restore(mixed, langs)[0] == s + "\n" + CLEAN["de"][1]


def test_sound_texts_stay(langs):
    for s in [x for v in CLEAN.values() for x in v] + ["", "plain ascii", "# CONFIGURAÇÃO Umnor", "Äpfel – “zitiert” § 7 … 4 °C", "naïve café"]:
        assert p10.restore(s, langs) == (s, (), False)
    assert p10.restore("R�vision", langs)[2]


def test_frame_of_garbled(spark):
    rows = [(k, x + f" {k}.", lang, 0) for lang, v in CLEAN.items() for x in v for k in range(30)]
    rows += [(1000, CLEAN["fr"][0].encode().decode("cp1252", "ignore"), None, 0), (1001, None, "fr", 0), (1002, "", "fr", 0), (None, "Ã©", "fr", 0), (1003, "x" * 200_000 + "é", "fr", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, restored int")
    assert {r.doc_id for r in p10.restored(df, "doc_id", "text", "lang").collect()} == {1000}
    assert p10.restored(df.limit(0), "doc_id", "text", "lang").count() == 0
