"""Problem 3: one consistent form for strings that look the same but differ in their characters.

Method: a mapping over grapheme clusters is compiled once, checked for conflicts, and applied in one
pass by longest match.  A cluster is a base character with the marks and invisible characters behind it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lodestone.llm.classes import variant_pairs
from lodestone.plans.session import materialize
from lodestone.sources.tables import table

# Letters of other scripts, and the Latin letter whose shape they have.
LETTERS = (
    ("Cyrillic", "АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝӏԌѴѵ", "ABESIJKMHOPCTYXaeopcyxsijhdqwlGVv"),
    ("Greek", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρυκϲϳϹͿ", "ABEZHIKMNOPTYXoavpukcjCJ"),
    ("Armenian", "ՍՏՕԼհոսցօքզյ", "USOLhnugoqqj"),
    ("Cherokee", "ᎪᎫᎬᎳᎷᎻᎾᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏭᏴᎠᎡᎢᎥ", "AJEWMHOGhZbRWSVSLCPKGBDRTi"),
    ("Lisu", "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    ("Coptic", "ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬⲟⲣⲥ", "HIKMNOPCTXopc"),
    ("Latin", "ɡ", "g"),
    ("signs", "⁄∕∶˸։", "//:::"),
)
#: Hyphens of one look; dashes are longer and stay.
HYPHENS = "‐‑﹣－"
#: Characters without a look: joiners, marks of direction, soft hyphen, variation selectors.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]
#: Compatibility characters that look like what they stand for: digraphs, dots, Roman numerals, radicals, ligatures.
ALIKE = [(0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2024, 0x2026), (0x2160, 0x217F), (0x2E80, 0x2FDF), (0xFB00, 0xFB4F)]
_TAGS = {"<wide>", "<narrow>", "<font>", "<noBreak>"}


def _folds(cp: int) -> str:
    """Whether this character's compatibility decomposition keeps its look."""
    d = unicodedata.decomposition(chr(cp))
    if not d:
        return ""
    tag = d.split(" ")[0]
    if not tag.startswith("<"):
        return unicodedata.normalize("NFD", chr(cp))
    if tag in _TAGS or (tag == "<compat>" and any(a <= cp <= b for a, b in ALIKE)):
        return unicodedata.normalize("NFKD", chr(cp))
    return ""


@lru_cache(1)
def mapping() -> dict[str, str]:
    """The single characters that change, by rule, and what they become.

    Raises ``ValueError`` on a conflict: a result that would itself be changed again, or a character
    with two results.
    """
    to = {a: b for _, letters, latin in LETTERS for a, b in zip(letters, latin, strict=True)} | dict.fromkeys(HYPHENS, "-") | {chr(c): "" for c in INVISIBLE}
    letters = dict(to)
    for cp in range(0x80, 0x30000):
        c = chr(cp)
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or 0xE000 <= cp <= 0xF8FF:
            continue
        if unicodedata.category(c) == "Zs":
            new = " "
        elif c in letters:
            continue
        elif unicodedata.combining(c) and not unicodedata.decomposition(c):
            continue
        else:
            parts = _folds(cp) or c
            new = unicodedata.normalize("NFC", "".join(letters.get(x, x) for x in parts))
        if new != c:
            if to.setdefault(c, new) != new:
                raise ValueError(f"conflict for {cp:x}")
    for c, new in to.items():
        if any(x in to for x in new):
            raise ValueError(f"{ord(c):x} becomes {new!r}, which changes again")
    return to


class _Clusters(dict):
    """Results by cluster; one not met before is made from its characters."""

    def __missing__(self, cluster: str) -> str:
        chars, made = mapping(), cluster
        for _ in range(4):  # composing can yield a character that is mapped in turn
            new = unicodedata.normalize("NFC", "".join(chars.get(x, x) for x in unicodedata.normalize("NFD", made)))
            if new == made:
                break
            made = new
        if len(self) < 1_000_000:
            self[cluster] = made
        return made


@lru_cache(1)
def _transducer() -> tuple[re.Pattern[str], _Clusters]:
    def cls(points: list[int]) -> str:
        out, points = [], sorted(points)
        i = 0
        while i < len(points):
            j = i
            while j + 1 < len(points) and points[j + 1] == points[j] + 1:
                j += 1
            out.append(re.escape(chr(points[i])) + ("-" + re.escape(chr(points[j])) if j > i else ""))
            i = j + 1
        return "".join(out)

    marks = [c for c in range(0x300, 0x1FFFF) if unicodedata.combining(chr(c))]
    behind = cls(sorted({*marks, *INVISIBLE}))
    single = cls([ord(c) for c in mapping() if ord(c) not in set(INVISIBLE)])
    return re.compile(f"[^{behind}][{behind}]+|[{single}]|[{behind}]+", re.DOTALL), _Clusters()


def one_form(s: str | None) -> str | None:
    """The consistent form: strings that look the same get the same one.

    Widths, composition of accents, invisible characters, kinds of blank and hyphen, ligatures and
    look-alike letters of other scripts are unified.  Case, accents, digits, dashes, line breaks and
    the number of blanks are kept.  Null stays null, the empty string empty.  Idempotent.
    """
    if s is None or s.isascii():
        return s
    pattern, clusters = _transducer()
    return pattern.sub(lambda m: clusters[m[0]], s)


def one_form_column(text: Column) -> Column:
    """:func:`one_form` of a string column."""

    @pandas_udf("string")
    def form(s):  # noqa: ANN001, ANN202
        return s.map(one_form, na_action="ignore")

    return form(text)


def look_classes(df: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns, ``cls`` (128-bit digest of the consistent form) and ``variant`` (64-bit hash of the string).

    Rows with null text give none.  Only digests leave the Python worker; texts are not shuffled.
    """
    import hashlib

    cols = df.select(*keep, F.col(text).alias("_t")).where(F.col("_t").isNotNull())
    kept = ", ".join(f"`{c}` {cols.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_t").to_pylist()
            cls, var = [], []
            for t in texts:
                raw = t.encode("utf-8", "surrogatepass")
                f = one_form(t)
                cls.append(hashlib.blake2b(raw if f is t else f.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                var.append(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(cls, pa.binary()), pa.array(var, pa.int64())], names=[*keep, "cls", "variant"])

    return cols.mapInArrow(run, f"{kept}, cls binary, variant bigint")


def _strings(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("key"), F.col("filename").alias("text"))
    chunks = table(spark, root, "chunks").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("key"), "text")
    return docs.unionByName(chunks).where("key IS NOT NULL AND text IS NOT NULL AND text <> ''")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents by file name, chunks by text, that differ as strings and look the same."""
    return variant_pairs(materialize(look_classes(_strings(spark, root), "text", ("tbl", "key")), "looks"))


def p3_forms(spark: SparkSession, root: str) -> DataFrame:
    """The consistent form of every file name and chunk text that has another."""
    s = _strings(spark, root).where(F.col("text").rlike("[^\\x00-\\x7F]")).withColumn("form", one_form_column(F.col("text")))
    return s.where("form <> text").select("tbl", "key", F.md5("text").alias("text_md5"), F.md5("form").alias("form_md5"), F.length("form").alias("form_chars")).distinct()


QUERIES = {"p3_found": p3_found, "p3_forms": p3_forms}
ORACLE: dict[str, str] = {}
