"""Sources: raw files, evaluation sets, prompts, page and segment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import PandasUDFType, pandas_udf

# Decoders in the order they are tried; formula marks.
DECODERS = ("utf-8", "gb18030", "latin-1")
FORMULA = r"^\s*(\$\$.*\$\$|\$.*\$|\\\[.*\\\]|\\begin\{.*)\s*$"


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, length, modified, content of files; the listing comes without reading contents if they are not selected."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.col("modificationTime").alias("modified"), "content")


def decoded(content: Column) -> Column:
    """Text of bytes by the first decoder that takes them; UTF-8 is decided in the JVM, the others in Arrow batches."""

    def others(s):  # noqa: ANN001, ANN202
        def one(b: bytes | None) -> str | None:
            if b is None:
                return None
            for d in DECODERS:
                try:
                    return bytes(b).decode(d)
                except UnicodeDecodeError:
                    continue
            return None

        return s.map(one)

    slow = pandas_udf(others, T.StringType(), functionType=PandasUDFType.SCALAR)
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(slow(content))


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """question, ground_truth, kb_id, expected_citations (empty where missing) of a JSON-lines file; blank lines are skipped."""
    schema = "question string, ground_truth string, kb_id string, expected_citations array<string>"
    return spark.read.schema(schema).json(path).where("question IS NOT NULL").withColumn("expected_citations", F.coalesce("expected_citations", F.array().cast("array<string>")))


def baseline(spark: SparkSession, path: str, metrics: list[str]) -> DataFrame:
    """key, metric, value of a JSON array of figures per question."""
    d = spark.read.schema("question string, " + ", ".join(f"{m} double" for m in metrics)).json(path, multiLine=True)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return d.select(F.col("question").alias("key"), F.explode(rows).alias("x")).select("key", "x.metric", "x.value").where("value IS NOT NULL")


def line_atoms(pages: DataFrame) -> DataFrame:
    """Atoms of page texts (doc_id, page, text), one a line: formulas by their marks; pages of under 8 characters are images."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("n", "line"), (F.length(F.trim("text")) < 8).alias("image"))
    text = lines.where("NOT image AND trim(line) <> ''").select("doc_id", "page", "n", F.when(F.col("line").rlike(FORMULA), "formula").otherwise("text").alias("type"), F.trim("line").alias("text"))
    images = lines.where("image AND n = 0").select("doc_id", "page", "n", F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))
    return text.unionByName(images)


def segment_atoms(segments: DataFrame) -> DataFrame:
    """Atoms of speech segments (doc_id, start_s, end_s, speaker, text), numbered by their start."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("start_s", "end_s", "text")
    return segments.where(F.trim("text") != "").withColumn("seq", F.row_number().over(w) - 1).select(F.format_string("%s#%04d", F.col("doc_id").cast("string"), F.col("seq")).alias("atom_id"), "doc_id", "seq", F.trim("text").alias("text"), "start_s", "end_s", "speaker")


def render(template: Column, **values: Column) -> Column:
    """A template with ``{{name}}`` replaced; a name left over makes it null."""
    out = template
    for k, v in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), F.coalesce(v.cast("string"), F.lit("")))
    return F.when(~out.rlike("\\{\\{\\w+\\}\\}"), out)
