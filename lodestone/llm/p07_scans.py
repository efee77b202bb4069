"""Problem 7: turn text of scanned pages into continuous paragraphs.

Method: a line classifier (boosted stumps) tells page furniture from running text, a classifier of
line pairs (likewise) finds words broken at a line's end, and misread words get their candidates from an inverted
join over character trigrams, from which boosted stumps choose.  The lexicon is the words of all atoms.

Pages of a document are numbered and dealt in windows of WINDOW pages, each with the pages before and behind
that its lines are compared with.  So documents of any length are spread over tasks, and come out
as if each was read in one go.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.boost import Boost
from lodestone.plans.session import materialize, parallelism
from lodestone.sources.tables import table

#: A word is known if at least this share of all atoms (and 3 atoms) hold it: at any size of the corpus.
KNOWN = 1e-4
#: Share of a document's line breaks that lie within a sentence, from which it counts as scanned.
WRAPPED = 0.2
#: Most lines, and most words, that the classifiers are fitted on.
LINES, WORDS = 20_000, 1_500
#: Non-empty lines at either end of a page that can be furniture.
EDGE = 3
HYPHENS = "-‐‑­¬"
#: Pages of a window, pages at either side that lines at a page's ends are compared with.
WINDOW, REACH = 64, 4
#: Probability of going on below which a hyphen hangs: nearly all hyphens at a line's end break a word.
HANGS = 0.25
WORD = r"[\p{L}\p{N}@]+(?:['’\-][\p{L}\p{N}@]+)*"
_WORD = re.compile(r"[^\W_@]+(?:@[^\W_]*)*(?:['’\-][^\W_]+)*|@[^\W_@]+")

# What scanners take for what.
CONFUSIONS = [
    ("d", "cl"), ("n", "ri"), ("u", "ii"), ("m", "rn"), ("w", "vv"), ("s", "5"), ("o", "0"), ("l", "1"), ("i", "1"), ("i", "l"), ("l", "i"), ("a", "@"),
    ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("h", "b"), ("b", "h"), ("g", "9"), ("b", "6"), ("b", "8"), ("z", "2"), ("v", "y"), ("y", "v"), ("n", "h"),
    ("h", "n"), ("a", "o"), ("o", "a"), ("e", "o"), ("o", "e"), ("q", "g"), ("g", "q"), ("u", "v"), ("v", "u"), ("u", "n"), ("n", "u"), ("li", "h"), ("h", "li"), ("rn", "m"), ("m", "nn"), ("cl", "d"), ("t", "l"), ("l", "t"), ("i", "j"), ("ri", "n"), ("ii", "u"), ("in", "m"), ("m", "in"), ("nn", "m"), ("k", "lc"), ("0", "o"), ("1", "l"), ("t", "+"),
]
_SURE = set(CONFUSIONS[:20]) | {("v", "y"), ("k", "lc")}


def plain(word: str) -> str:
    """Lower case, one kind of apostrophe."""
    return word.lower().replace("’", "'")


def words_of(line: str) -> list[str]:
    return [plain(w) for w in _WORD.findall(line.replace("­", "").replace("¬", ""))]


def edits(read: str, real: str, most: int = 2) -> tuple[float, int] | None:
    """(cost, other edits) that lead from ``real`` to ``read``: a usual confusion costs 0.2 or 0.5, any
    other edit of a character 1; None beyond ``most``."""
    n, m = len(real), len(read)
    if abs(n - m) > 2:
        return None
    best: dict[tuple[int, int], tuple[float, int]] = {(0, 0): (0.0, 0)}
    for i in range(n + 1):
        for j in range(max(0, i - 2), min(m, i + 2) + 1):
            here = best.get((i, j))
            if here is None or here[0] > most:
                continue

            def go(a: int, b: int, cost: float, other: int, here: tuple[float, int] = here) -> None:
                new = (here[0] + cost, here[1] + other)
                if new < best.get((a, b), (9.0, 9)):
                    best[(a, b)] = new

            if i < n and j < m and real[i] == read[j]:
                go(i + 1, j + 1, 0, 0)
            else:
                if i < n and j < m:
                    go(i + 1, j + 1, 1, 1)
                if i < n:
                    go(i + 1, j, 1, 1)
                if j < m:
                    go(i, j + 1, 1, 1)
            for a, b in CONFUSIONS:
                if real.startswith(a, i) and read.startswith(b, j):
                    go(i + len(a), j + len(b), 0.2 if (a, b) in _SURE else 0.5, 0)
    end = best.get((n, m))
    return end if end is not None and end[0] <= most else None


def grams(word: str) -> list[str]:
    w = f"^^{word}$$"
    return sorted({w[i : i + 3] for i in range(len(w) - 2)})


def _candidate_features(read: str, real: str, common: int, share: float) -> list[float] | None:
    e = edits(read, real)
    if e is None or read == real:
        return None
    return [e[0], e[1], common / max(1, len(set(grams(real)))), float(np.log10(share + 1e-9)), len(real), float(any(c.isdigit() or c == "@" for c in read)), abs(len(real) - len(read))]


def fit_words(lexicon: list[tuple[str, float]], seed: int = 3) -> Boost:
    """A ranker of candidates, from words corrupted by the confusions and their other neighbours."""
    r = np.random.default_rng(seed)
    by_gram: dict[str, list[int]] = {}
    lexicon = [(w, s) for w, s in lexicon if w.isalpha()][:WORDS]
    for k, (w, _) in enumerate(lexicon):
        for g in grams(w):
            by_gram.setdefault(g, []).append(k)
    x, y = [], []

    def near(u: str) -> list[tuple[int, int]]:
        hits: dict[int, int] = {}
        for g in grams(u):
            for k in by_gram.get(g, ()):
                hits[k] = hits.get(k, 0) + 1
        return sorted(hits.items(), key=lambda z: -z[1])[:12]

    for k, (w, _) in enumerate(lexicon):
        ways = [(i, a, b) for a, b in CONFUSIONS for i in range(len(w)) if w.startswith(a, i)]
        if len(w) >= 4 and ways:
            i, a, b = ways[r.integers(len(ways))]
            u = w[:i] + b + w[i + len(a) :]
            for c, n in near(u):
                if (f := _candidate_features(u, lexicon[c][0], n, lexicon[c][1])) is not None:
                    x.append(f)
                    y.append(c == k)
        # words that are right, and made-up ones, have no candidate that is
        fake = w[:2] + "".join(r.permutation(list(w[2:])))
        for u in (w, fake):
            for c, n in near(u):
                if (f := _candidate_features(u, lexicon[c][0], n, lexicon[c][1])) is not None:
                    x.append(f)
                    y.append(False)
    return Boost().fit(np.array(x, float).reshape(-1, 7), np.array(y, float))


_PAGE_NUMBER = re.compile(
    r"^[\[(\-–—•·|.\s]*(?:(?:page|p\.?|seite|s\.|página|pág\.?|стр\.?|第)\s*)?(?:\d{1,5}|[ivxlc]{1,7})(?:\s*(?:/|of|von|de|sur|из|\|)\s*(?:\d{1,5}|[ivxlc]{1,7}))?[\])\-–—•·|.\s页]*$", re.IGNORECASE
)
_DIGITS = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "|": "1", "b": "6", "g": "9", "q": "9", "i": "1"})


def number_like(line: str) -> bool:
    """A page number, letters taken for digits included."""
    s = line.strip()
    return bool(s) and (_PAGE_NUMBER.match(s) is not None or (len(s) <= 24 and any(c.isdigit() for c in s) and _PAGE_NUMBER.match(re.sub(r"\b(?!of\b|de\b|von\b)[\dOolISsBZzbgqi|]+\b", lambda m: m[0].translate(_DIGITS), s)) is not None) or re.fullmatch(r"[\[(\- ]*[\dlOIoS]{1,4}(?: */ *[\dlOIoS]{1,4})?[\])\- ]*", s) is not None and len(s) > 1)


def _shape(line: str) -> set[str]:
    s = re.sub(r"\d+", "#", re.sub(r"\s+", " ", line.strip().lower()))
    s = re.sub(r"^# | #$", "", s)
    return {s[i : i + 2] for i in range(len(s) - 1)} or {s}


def _alike(a: set[str], b: set[str]) -> float:
    return 2 * len(a & b) / max(1, len(a) + len(b))


def edge_lines(pages: list[list[str]], usual: float) -> dict[tuple[int, int], list[float]]:
    """Features of the lines at the ends of pages: (page, line index) to a row; words are added later.

    ``usual`` is the usual width of the document's lines.
    """
    flat: list[tuple[int, int, int, bool]] = []
    for p, lines in enumerate(pages):
        full = [i for i, x in enumerate(lines) if x.strip()]
        for rank, i in enumerate(full[:EDGE]):
            flat.append((p, i, rank, True))
        for rank, i in enumerate(full[::-1][:EDGE]):
            if i not in full[:EDGE]:
                flat.append((p, i, rank, False))
    shapes = {(p, i): _shape(pages[p][i]) for p, i, *_ in flat}
    by_place: dict[tuple[int, bool], list[tuple[int, int]]] = {}
    for p, i, rank, top in flat:
        by_place.setdefault((min(rank, 1), top), []).append((p, i))
    out = {}
    for p, i, rank, top in flat:
        line = pages[p][i]
        s = line.strip()
        others = [shapes[o] for r in (0, 1) for o in by_place.get((r, top), []) if abs(o[0] - p) <= REACH and o[0] != p]
        sims = sorted((_alike(shapes[(p, i)], o) for o in others), reverse=True)
        letters = [c for c in s if c.isalpha()]
        lines_after = pages[p][i + 1 : i + 2]
        out[(p, i)] = [
            sims[0] if sims else 0.0,
            sims[1] if len(sims) > 1 else 0.0,
            float(number_like(s)),
            len(s) / usual,
            float(rank),
            sum(c.isupper() for c in letters) / max(1, len(letters)),
            float(bool(re.match(r"^\d+\s{2,}", s) or re.search(r"\s{2,}[\dlOIoS]+$", s))),
            float(s[-1:] in ".!?。！？,;:"),
            float(s[:1].islower() or s[:1] in "(/&+»"),
            float(bool(re.search(r"[\dlOI]$", s))),
            sum(c.isdigit() for c in s) / max(1, len(s)),
            float(bool(lines_after) and not lines_after[0].strip()),
            float(top),
            float(len(s.split())),
        ]
    return out


N_EDGE = 14


def scanned(atoms: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, atom_id, page, text of the pages of scanned documents, repeated rows once.

    A document is scanned if its parser says so, or if it came as PDF or image and its lines are
    wrapped within sentences.  Null texts and atoms without a document do not count.
    """
    of = docs.where(F.col("mimetype").isin("application/pdf", "image/tiff", "image/png", "image/jpeg") | (F.col("metadata")["parser"] == "ocr"))
    of = of.select("doc_id", F.coalesce(F.col("metadata")["parser"] == "ocr", F.lit(False)).alias("ocr"))
    a = atoms.where((F.col("type") == "text") & F.col("text").isNotNull()).select("doc_id", "atom_id", "page", "text")
    p = a.join(of, "doc_id").dropDuplicates(["atom_id", "text"])
    inner = F.regexp_count("text", F.lit(r"[\p{L}\p{N},\-‐¬­] *\n *[\p{Ll}(]"))
    every = F.regexp_count("text", F.lit(r"[^\n ] *\n *[^\n ]"))
    w = p.groupBy("doc_id").agg((F.sum(inner) / F.greatest(F.lit(1), F.sum(every))).alias("wrapped"), F.sum(every).alias("breaks"), F.max("ocr").alias("ocr"))
    scans = w.where(F.col("ocr") | ((F.col("wrapped") > WRAPPED) & (F.col("breaks") >= 3))).select("doc_id")
    return p.select("doc_id", "atom_id", "page", "text").join(scans, "doc_id", "left_semi")


def ordered(pages: DataFrame) -> DataFrame:
    """``pages`` with ``no``, their number in the document, and ``usual``, the usual width of its lines.

    The order is by page, then by the number in the atom's id; a page without number follows the one
    before it.  Numbers are counted within blocks of pages first, and blocks are added up, so that no
    task sorts a whole document.  The usual width is the median of the pages' medians.
    """
    seq = F.coalesce(F.regexp_extract("atom_id", r"(\d+)$", 1).try_cast("bigint"), F.lit(0))
    p = pages.withColumn("_seq", seq).withColumn("_part", F.floor(F.col("_seq") / 1024))
    w = Window.partitionBy("doc_id", "_part").orderBy("_seq", "atom_id")
    before = F.last("page", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.first("page", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    p = p.withColumn("_page", F.coalesce(before, behind, F.lit(0))).withColumn("_block", F.floor(F.col("_page") / 256))
    wide = F.array_sort(F.filter(F.transform(F.split("text", "\n"), lambda x: F.length(F.trim(x))), lambda n: n > 0))
    p = p.withColumn("_wide", F.get(wide, F.floor(F.size(wide) / 2).cast("int")))
    usual = p.groupBy("doc_id").agg(F.coalesce(F.percentile_approx("_wide", 0.5, 1000), F.lit(1)).cast("double").alias("usual"))
    return numbered(p, ["_page", "_seq", "atom_id", "text"]).join(usual, "doc_id").select("doc_id", "atom_id", "text", "no", "usual")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (doc_id, _block, rising with the order) with ``no``, their number in the document from 0."""
    per = rows.groupBy("doc_id", "_block").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("doc_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    start = per.select("doc_id", "_block", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    at = F.row_number().over(Window.partitionBy("doc_id", "_block").orderBy(*order))
    return rows.withColumn("_at", at).join(start, ["doc_id", "_block"]).withColumn("no", F.col("_start") + F.col("_at") - 1).drop("_block", "_at", "_start")


def lexicon(atoms: DataFrame) -> tuple[DataFrame, int]:
    """word, share (of the atoms that hold it) of all known words; and the number of atoms."""
    texts = atoms.where((F.col("type") == "text") & F.col("text").isNotNull()).select("text")
    n = texts.count()
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.translate(F.lower("text"), "’­¬", "'"), F.lit(WORD), F.lit(0)))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    least = max(3.0, KNOWN * n)
    return counts.where(F.col("n") >= least).select("word", (F.col("n") / F.lit(float(max(1, n)))).alias("share")), n


def _by_window(df: DataFrame, f: Callable[[int, pd.DataFrame], list[tuple]], columns: str, reach: int, order: tuple[str, ...] = ()) -> DataFrame:
    """Run ``f`` on each window of pages (by ``no``) of each document, in order, with ``reach`` pages more at either side.

    Rows have ``own``: whether their page is one of the window's.  A window has a bounded number of pages.
    """
    names = [c.strip().split(" ")[0] for c in columns.split(",")]
    win = lambda n: F.floor(n / WINDOW)
    in_ = F.sequence(win(F.greatest(F.col("no") - reach, F.lit(0))), win(F.col("no") + reach))
    dealt = df.withColumn("win", F.explode(in_)).withColumn("own", F.col("win") == win(F.col("no")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def done(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            out = [r for (d, _), g in pdf.groupby(["doc_id", "win"], sort=False) if g["own"].any() for r in f(d, g)]
            if out:
                yield pd.DataFrame(out, columns=names)

        for pdf in batches:
            if not len(pdf):
                continue
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = (held["doc_id"] == held["doc_id"].iloc[-1]) & (held["win"] == held["win"].iloc[-1])
            if not last.all():
                yield from done(held[~last])
                held = held[last]
        if held is not None:
            yield from done(held)

    n = 2 * parallelism(df.sparkSession)
    return dealt.repartition(n, "doc_id", "win").sortWithinPartitions("doc_id", "win", "no", *order).mapInPandas(run, columns)


def _edges(d: int, g: pd.DataFrame) -> list[tuple]:
    pages = [t.split("\n") for t in g["text"]]
    atoms, own = list(g["atom_id"]), list(g["own"])
    return [(d, atoms[p], i, [float(v) for v in f], words_of(pages[p][i])) for (p, i), f in edge_lines(pages, float(g["usual"].iloc[0])).items() if own[p]]


def _full(row: tuple) -> list[float]:
    """Features of an edge line with the known words among its own."""
    f, n, known, titles = row
    n = max(1, n or 0)
    return [*f, (known or 0) / n, (titles or 0) / n, float(known or 0)]


def fit_lines(rows: list[tuple]) -> Boost:
    """The furniture classifier, from lines that are certain: ``rows`` hold features, words, known words, title words.

    Certain furniture recurs on two other pages or is a plain page number; certain text is wide, made of known
    words and recurs nowhere.
    """
    x, y = [], []
    for row in rows:
        f = _full(row)
        # a line that recurs, or a page number, or a title's words on a short line
        sure = f[1] > 0.8 or (f[2] and f[3] < 0.5) or (f[0] > 0.75 and f[3] < 0.75 and f[8] == 0) or (f[15] >= 0.5 and f[3] < 0.7 and f[8] == 0 and f[7] == 0 and row[2] - (row[3] or 0) <= 1)
        text = not f[2] and f[0] < 0.55 and (f[14] >= 0.5 and f[16] >= 3 or f[8] == 1)
        if sure != text:
            x.append(f)
            y.append(sure)
    return Boost().fit(np.array(x, float).reshape(-1, N_EDGE + 3), np.array(y, float))


_LAST = re.compile(rf"([^\W_@]+(?:['’\-][^\W_]+)*)[{HYPHENS}]\s*$")
_FIRST = re.compile(r"^\s*([^\W_]+(?:['’\-@][^\W_]+)*)")


def broken(line: str, following: str) -> tuple[str, str] | None:
    """The two parts of a word that goes on from ``line`` in the ``following`` line of text, if it does.

    A pair of lines is one of these if the first ends with a hyphen directly after a letter and
    the second begins with a letter or digit; a dash or hyphen that stands alone ends no word.
    """
    a, b = _LAST.search(line), _FIRST.match(following)
    return (a[1], b[1]) if a and b else None


def _pair_features(a: str, b: str, one: float, compound: float, first: float, second: float) -> list[float]:
    """Of the parts before and behind a hyphen and a line's end, with the shares of atoms that hold
    the word in one, the compound and the parts (0 if unknown)."""
    return [float(one > 0), float(compound > 0), float(first > 0), float(np.log10(second + 1e-9)), len(a), len(b), float(b[:1].islower()), float(any(c.isdigit() for c in a + b))]


def fit_pairs(lexicon: list[tuple[str, float]], seed: int = 4) -> Boost:
    """The classifier of line pairs: does the word before the hyphen go on in the next line?

    Fitted on known words cut in two, some of them as if they were not in the lexicon, against hyphens that
    hang, behind which another word of the language begins (in proportion to how common words are).
    """
    r = np.random.default_rng(seed)
    share = dict(lexicon)
    words = [w for w, _ in lexicon if w.isalpha() and len(w) >= 4]
    x, y = [], []
    if len(words) > 1:
        every = [w for w, _ in lexicon]
        p = np.array([v for _, v in lexicon]) / sum(v for _, v in lexicon)
        for k, w in enumerate(words):
            at = int(r.integers(2, len(w) - 1))
            a, b = w[:at], w[at:]
            hidden = k % 3 == 0
            x.append(_pair_features(a, b, 0.0 if hidden else share[w], 0.0, share.get(a, 0.0), share.get(b, 0.0)))
            y.append(True)
            if k % 2:  # a compound broken at its own hyphen
                b = words[int(r.integers(len(words)))]
                x.append(_pair_features(w, b, share.get(w + b, 0.0), 1e-3, share[w], share[b]))
                y.append(True)
            if k % 4 == 0:
                b = every[int(r.choice(len(every), p=p))]
                x.append(_pair_features(a, b, share.get(a + b, 0.0), 0.0, share.get(a, 0.0), share[b]))
                y.append(False)
    return Boost().fit(np.array(x, float).reshape(-1, 8), np.array(y, float))


def analysed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``lines`` (doc_id, atom_id, no, line_no, line, furniture, part_a, part_b, goes_on; ``no`` numbers the pages with running
    text), ``fixes`` (word, real) and the lexicon."""
    atoms, docs = table(spark, root, "atoms"), table(spark, root, "documents")
    pages = materialize(ordered(scanned(atoms, docs)), "pages")
    known, _ = lexicon(atoms)
    known = materialize(known, "lexicon")
    titles = atoms.where("context IS NOT NULL").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("context"), F.lit(WORD), F.lit(0)))).alias("word"))
    n_titles = titles.groupBy("word").agg(F.count("*").alias("n"))
    total = atoms.where("context IS NOT NULL").count()
    title_words = n_titles.where(F.col("n") >= max(3.0, 0.002 * total)).select("word", F.lit(1).alias("title"))

    edges = materialize(_by_window(pages, _edges, "doc_id bigint, atom_id string, line int, f array<double>, words array<string>", REACH), "edges")
    of_words = edges.select("atom_id", "line", F.explode("words").alias("word")).join(known, "word", "left").join(title_words, "word", "left")
    counts = of_words.groupBy("atom_id", "line").agg(F.count("*").alias("n"), F.count("share").alias("known"), F.count("title").alias("titles"))
    rows = edges.join(counts, ["atom_id", "line"], "left").select("doc_id", "atom_id", "line", "f", "n", "known", "titles")
    rows = materialize(rows, "edge-lines")
    n_rows = max(1, rows.count())
    part = max(1, round(min(1.0, LINES / n_rows) * 1_000_000))
    drawn = rows.where(F.pmod(F.xxhash64("atom_id", "line"), F.lit(1_000_000)) < part).select("f", "n", "known", "titles").limit(2 * LINES).collect()
    model = fit_lines([tuple(r) for r in drawn])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.array([_full(r) for r in pdf[["f", "n", "known", "titles"]].fillna(0).itertuples(index=False, name=None)])
                yield pdf.loc[model.probability(x) > 0.5, ["doc_id", "atom_id", "line"]]

    furniture = rows.mapInPandas(judge, "doc_id bigint, atom_id string, line int").groupBy("doc_id", "atom_id").agg(F.collect_set("line").alias("furniture"))
    marked = pages.join(furniture, ["doc_id", "atom_id"], "left").withColumn("furniture", F.coalesce("furniture", F.array().cast("array<int>")))
    has_text = F.exists(F.transform(F.split("text", "\n"), lambda x, i: (F.trim(x) != "") & ~F.array_contains("furniture", i)), lambda x: x)
    marked = materialize(marked.withColumn("running", has_text).drop("usual"), "marked")
    # pages with running text are numbered anew, so the next line of text is on the same page or the next one
    running = numbered(marked.where("running").withColumn("_block", F.floor(F.col("no") / 256)).withColumnRenamed("no", "_no"), ["_no"]).drop("_no")

    def lines(d: int, g: pd.DataFrame) -> list[tuple]:
        out: list[list] = []
        for a, no, own, t, f in zip(g["atom_id"], g["no"], g["own"], g["text"], g["furniture"], strict=True):
            f = {int(v) for v in f}
            out += [[own, d, a, no, i + 1, line, i in f, None, None, False] for i, line in enumerate(t.split("\n"))]
        text = [k for k, r in enumerate(out) if not r[6] and r[5].strip()]
        for k, j in zip(text, text[1:], strict=False):
            if (two := broken(out[k][5], out[j][5])) is not None:
                out[k][7], out[k][8] = two
                out[j][9] = True  # its first word belongs to the line before
        return [tuple(r[1:]) for r in out if r[0]]

    schema = "doc_id bigint, atom_id string, no bigint, line_no int, line string, furniture boolean, part_a string, part_b string, goes_on boolean"
    paired = materialize(_by_window(running, lines, schema, 1), "pairs")
    rest = marked.where("NOT running").select("doc_id", "atom_id", F.lit(None).cast("bigint").alias("no"), F.posexplode(F.split("text", "\n")).alias("i", "line"), "furniture")
    rest = rest.select("doc_id", "atom_id", "no", (F.col("i") + 1).alias("line_no"), "line", F.array_contains("furniture", F.col("i")).alias("furniture"))
    none = F.lit(None).cast("string")
    sample = [(r[0], r[1]) for r in known.where(F.length("word") >= 2).orderBy(F.xxhash64("word")).limit(WORDS).collect()]
    every = _only_broken(paired, known, fit_pairs(sample)).unionByName(rest.withColumn("part_a", none).withColumn("part_b", none).withColumn("goes_on", F.lit(False)))
    every = materialize(every, "lines")

    words = _line_words(every).select("word").distinct()
    unknown = words.where(F.length("word") >= 4).join(known, "word", "left_anti")
    found = materialize(_fixes(unknown, known), "fixes")
    return every, found, known


def _only_broken(paired: DataFrame, known: DataFrame, model: Boost) -> DataFrame:
    """Without the pairs of lines whose hyphen hangs (as of a compound that a later word completes)."""
    a, b = (F.translate(F.lower(c), "’", "'") for c in ("part_a", "part_b"))
    two = paired.where("part_a IS NOT NULL").select("atom_id", "line_no", "part_b", a.alias("a"), b.alias("b"))
    looked = two.withColumn("one", F.concat("a", "b")).withColumn("comp", F.concat("a", F.lit("-"), "b"))
    for name, on in (("k1", "one"), ("k2", "comp"), ("k3", "a"), ("k4", "b")):
        looked = looked.join(known.select(F.col("word").alias(on), F.col("share").alias(name)), on, "left")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                k = pdf[["k1", "k2", "k3", "k4"]].fillna(0.0).to_numpy()
                x = np.array([_pair_features(a, b, *v) for a, b, v in zip(pdf["a"], pdf["part_b"], k, strict=True)])
                yield pdf.loc[model.probability(x) < HANGS, ["atom_id", "line_no"]]

    hanging = looked.select("atom_id", "line_no", "a", "part_b", "k1", "k2", "k3", "k4").mapInPandas(judge, "atom_id string, line_no int").withColumn("_h", F.lit(1))
    out = paired.join(hanging, ["atom_id", "line_no"], "left")
    part = lambda c: F.when(F.col("_h").isNull(), F.col(c)).alias(c)
    return out.select("doc_id", "atom_id", "no", "line_no", "line", "furniture", part("part_a"), part("part_b"), "goes_on")


def _line_words(every: DataFrame) -> DataFrame:
    """atom_id, line_no, word of running text, broken words made whole and counted on both their lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, n, line, x, y, on in zip(*(pdf[c] for c in ("atom_id", "line_no", "line", "part_a", "part_b", "goes_on")), strict=True):
                body = line
                if x is not None:
                    m = _LAST.search(body)
                    body = body[: m.start()]
                    one = plain(x) + plain(y)
                    # a compound keeps its hyphen; each part is looked up as well
                    out.append((a, n, one, plain(x) + "-" + plain(y)))
                if on:
                    body = _FIRST.sub("", body, count=1)
                out += [(a, n, w, None) for w in words_of(body)]
            yield pd.DataFrame(out, columns=["atom_id", "line_no", "word", "compound"])

    text = every.where("NOT furniture").select("atom_id", "line_no", "line", "part_a", "part_b", "goes_on")
    return text.mapInPandas(run, "atom_id string, line_no int, word string, compound string")


def _fixes(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """word, real: the known word that each unknown word was misread from, where one is likely.

    Candidates come from an inverted join over trigrams: one confusion changes at most five of them.
    """
    sample = [(r[0], r[1]) for r in known.where(F.length("word") >= 3).orderBy(F.xxhash64("word")).limit(WORDS).collect()]
    model = fit_words(sample)

    def of(df: DataFrame, name: str) -> DataFrame:
        w = F.concat(F.lit("^^"), F.col("word"), F.lit("$$"))
        g = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3)))
        return df.withColumn("gram", g).withColumnRenamed("word", name).withColumn("gram", F.explode("gram"))

    real = of(known.where(F.length("word") >= 3), "real")
    hits = of(unknown, "word").join(real, "gram").groupBy("word", "real", "share").agg(F.count("*").alias("common"))
    hits = hits.where((F.abs(F.length("word") - F.length("real")) <= 2) & (F.col("common") >= F.greatest(F.lit(2), F.length("real") - 3)))

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, x = [], []
            for k, (w, r, n, s) in enumerate(zip(pdf["word"], pdf["real"], pdf["common"], pdf["share"], strict=True)):
                f = _candidate_features(w, r, n, s)
                if f is not None and f[1] == 0:  # an edit that no scanner makes is another word
                    at.append(k)
                    x.append(f)
            if at:
                out = pdf.iloc[at][["word", "real"]].copy()
                out["p"] = model.probability(np.array(x))
                yield out[out["p"] > 0.5]

    # a given number of partitions stays as it is, so the small rows are not joined into one task
    ranked = hits.repartition(2 * parallelism(hits.sparkSession), "word", "real").mapInPandas(rank, "word string, real string, p double")
    return ranked.groupBy("word").agg(F.max_by("real", F.struct("p", "real")).alias("real"))


def noise(spark: SparkSession, root: str) -> DataFrame:
    every, found, _ = analysed(spark, root)
    w = _line_words(every)
    misread = w.join(found, "word").select("atom_id", "line_no").distinct().withColumn("noise", F.lit("misread"))
    furniture = every.where("furniture").select("atom_id", "line_no", F.lit("furniture").alias("noise"))
    breaks = every.where("part_a IS NOT NULL").select("atom_id", "line_no", F.lit("break").alias("noise"))
    return furniture.unionByName(breaks).unionByName(misread).distinct()


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Lines of scanned pages that are furniture, end in a broken word, or hold a misread one."""
    return noise(spark, root)


def paragraphs(rows: DataFrame) -> DataFrame:
    """doc_id, paragraph_no, paragraph, from lines of running text in windows of pages.

    ``rows``: doc_id, no, line_no, atom_id, line, fix (misread words of the line), part_a, compound.  A window yields pieces; one that
    began in the window before is joined to it, and numbers are added up over windows.
    """

    def build(d: int, g: pd.DataFrame) -> list[tuple]:
        out: list[list] = []  # text, whether it goes on from before, whether it is open, what joins it to what follows
        fresh, page = False, None
        for a, line, fix, x, comp in zip(*(g[c] for c in ("atom_id", "line", "fix", "part_a", "compound")), strict=True):
            if not line.strip():
                if a == page:
                    fresh = True
                    if out:
                        out[-1][2] = False
                page = a
                continue
            page = a
            s = line.strip()
            if x is not None:
                s = s[: _LAST.search(s).end(1)] + ("-" if comp else "")
            if out and not fresh:
                s = out[-1][0] + out[-1][3] + s
            else:
                out.append(["", not fresh, True, ""])
            for k, v in sorted(dict(fix).items()) if fix is not None else ():
                s = re.sub(rf"(?<![^\W_]){re.escape(k)}(?![^\W_])", lambda m, v=v: v.capitalize() if m[0][:1].isupper() else v, s, flags=re.IGNORECASE)
            out[-1][0], out[-1][3], fresh = s, "" if x is not None else " ", False
        return [(d, int(g["win"].iloc[0]), k, *p) for k, p in enumerate(out)]

    pieces = materialize(_by_window(rows, build, "doc_id bigint, win bigint, k int, text string, goes_on boolean, is_open boolean, glue string", 0, ("line_no",)), "pieces")
    per = pieces.groupBy("doc_id", "win").agg(F.count("*").alias("n"), F.min_by("goes_on", "k").alias("goes_on"), F.max_by("is_open", "k").alias("is_open"))
    w = Window.partitionBy("doc_id").orderBy("win")
    joined = (F.col("goes_on") & F.coalesce(F.lag("is_open").over(w), F.lit(False))).cast("int")
    per = per.select("doc_id", "win", "n", joined.alias("joined"))
    upto = F.sum(F.col("n") - F.col("joined")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = per.select("doc_id", "win", (upto - F.col("n")).alias("first"))
    p = pieces.join(first, ["doc_id", "win"]).select("doc_id", (F.col("first") + F.col("k")).cast("int").alias("paragraph_no"), F.struct("win", "text", "glue").alias("p"))
    many = p.groupBy("doc_id", "paragraph_no").agg(F.array_sort(F.collect_list("p")).alias("p"))
    text = F.aggregate("p", F.struct(F.lit("").alias("text"), F.lit("").alias("glue")), lambda s, x: F.struct(F.concat(s["text"], s["glue"], x["text"]).alias("text"), x["glue"].alias("glue")), lambda s: s["text"])
    return many.select("doc_id", "paragraph_no", text.alias("paragraph"))


def p7_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    """The repaired running text of each scanned document, one row a paragraph."""
    every, found, lex = analysed(spark, root)
    w = _line_words(every).select("atom_id", "line_no", "word").join(found, "word").groupBy("atom_id", "line_no").agg(F.map_from_entries(F.collect_set(F.struct("word", "real"))).alias("fix"))
    pair = F.concat(F.lower("part_a"), F.lit("-"), F.lower("part_b"))
    known = every.where("part_a IS NOT NULL").select(pair.alias("word")).distinct().join(lex, "word", "left_semi").withColumn("compound", F.lit(True))
    rows = every.where("NOT furniture AND no IS NOT NULL").join(w, ["atom_id", "line_no"], "left").withColumn("word", pair).join(known, "word", "left").drop("word")
    return paragraphs(rows)


QUERIES = {"p7_found": p7_found, "p7_paragraphs": p7_paragraphs}
ORACLE: dict[str, str] = {}
