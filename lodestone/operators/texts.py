"""Text operators over whole tables: hashes, normal forms, splitting, extraction from model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lodestone.functions.text import token_count
from lodestone.sources.tables import table

# Words that carry no meaning in a query.
STOPWORDS = (
    "的", "了", "是", "在", "和", "与", "及", "或", "也", "都", "很", "有",
    "被", "把", "对", "于", "以", "为", "等", "吗", "呢", "啊", "吧", "这",
    "那", "如何", "怎么", "what", "how", "why", "when", "where", "who", "which", "the", "a",
    "an", "is", "are", "of", "to", "in", "on", "for", "and", "or", "with", "by",
    "from", "that", "this", "it", "its", "as", "at", "do", "does", "did", "can", "could",
    "would",
)
SENTENCE_END = "(?<=[。！？!?；;])"


def normalized_bytes(content: Column) -> Column:
    """One byte-order mark off, line ends as LF, trailing white space off; bytes stay bytes."""
    s = F.decode(content, "ISO-8859-1")
    s = F.regexp_replace(s, "^(ï»¿|ÿþ|þÿ)", "")
    s = F.regexp_replace(s, "\r\n?", "\n")
    return F.encode(F.regexp_replace(s, "[ \\t\\n\\r\\x0b\\f]+$", ""), "ISO-8859-1")


def document_hash(content: Column) -> Column:
    """SHA-256 of the normalised bytes."""
    return F.sha2(normalized_bytes(content), 256)


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^\\s+", ""), "\\s+$", "")


def content_hash(text: Column) -> Column:
    """SHA-256 of the stripped text; null counts as empty."""
    return F.sha2(F.encode(stripped(F.coalesce(text, F.lit(""))), "utf-8"), 256)


def sentences(text: Column) -> Column:
    """Sentences with their terminators; an ASCII full stop ends none.  Blank ones are left out."""
    return F.filter(F.split(stripped(text), SENTENCE_END), lambda s: F.trim(F.regexp_replace(s, "\\s+", " ")) != "")


def normalized_query(text: Column) -> Column:
    """Lower case, only letters, digits and blanks, without stop words and single characters."""
    s = F.regexp_replace(F.lower(text), "[-_/]", " ")
    s = F.regexp_replace(s, "[^\\p{L}\\p{N}\\s]", "")
    words = F.filter(F.split(s, "\\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))
    return F.array_join(words, " ")


def nfkc(text: Column) -> Column:
    """Compatibility composition; Spark has no such function."""

    @pandas_udf("string")
    def composed(s):  # noqa: ANN001, ANN202
        return s.str.normalize("NFKC")

    return composed(text)


def normalized_name(name: Column) -> Column:
    """The key of an entity: NFKC, stripped, lower case, no punctuation, single blanks."""
    s = F.lower(stripped(nfkc(name)))
    s = F.regexp_replace(s, "[^\\p{L}\\p{N}_\\s]", "")
    return F.regexp_replace(s, "\\s+", " ")


def table_header(text: Column) -> Column:
    """The first two lines of a pipe table if the second is its rule, else empty."""
    lines = F.split(stripped(text), "\n")
    a, b = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    is_table = (F.size(lines) >= 2) & F.contains(a, F.lit("|")) & F.regexp_replace(stripped(b), "[|\\-: ]", "").eqNullSafe("")
    return F.when(is_table, F.concat_ws("\n", a, b)).otherwise("")


CONFIDENCE = "(?i)confidence\\s*:\\s*(0?\\.\\d+|1\\.0+)"


def confidence(text: Column) -> Column:
    """The first stated confidence, 0.5 where none is."""
    c = F.regexp_extract(text, CONFIDENCE, 1)
    return F.when(c == "", F.lit(0.5)).otherwise(F.least(F.lit(1.0), c.try_cast("double")))


def without_confidence(text: Column) -> Column:
    """The text without its first statement of confidence."""
    at = F.regexp_instr(text, F.lit(CONFIDENCE))
    n = F.length(F.regexp_extract(text, CONFIDENCE, 0))
    return stripped(F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + n, F.length(text)))).otherwise(text))


def char_grams(text: Column, n: int) -> Column:
    """Character n-grams of the stripped text; a shorter one is its own gram, an empty one has none."""
    t = stripped(text)
    m = F.length(t)
    return F.when(m == 0, F.array().cast("array<string>")).when(m < n, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(m - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n))))


def rolling_hash(gram: Column) -> Column:
    """``h = (h * 131 + code point) mod 2^32`` over the characters."""
    chars = F.filter(F.split(gram, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda h, c: (h * 131 + F.ascii(c)).bitwiseAND(F.lit(4294967295)))


def parsed_triplets(text: Column) -> Column:
    """(head, tail) of ``<triplet> head <subj> tail <obj>`` marks."""
    p = "<triplet>\\s*([^<]+)\\s*<subj>\\s*([^<]+)\\s*<obj>"
    return F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("h"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("t")), lambda x: F.struct(F.trim(x["h"]).alias("head"), F.trim(x["t"]).alias("tail")))


def q_token_count(spark: SparkSession, root: str) -> DataFrame:
    """Heuristic tokens of every chunk, and how far the stored count is off."""
    c = table(spark, root, "chunks").where("chunk_id IS NOT NULL").dropDuplicates(["chunk_id", "text"])
    return c.select("chunk_id", token_count(F.col("text")).alias("tokens"), (F.col("token_count") - token_count(F.col("text"))).alias("off"))


def q_document_hash(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose stored hash does not belong to their bytes."""
    d = table(spark, root, "documents").where("content IS NOT NULL AND doc_hash IS NOT NULL")
    return d.groupBy("kb_id").agg(F.count("*").alias("n"), F.sum((document_hash(F.col("content")) == F.col("doc_hash")).cast("bigint")).alias("same"))


def q_document_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Documents kept and dropped per knowledge base: the first of each (kb_id, hash) is kept."""
    d = table(spark, root, "documents").where("content IS NOT NULL AND doc_hash IS NOT NULL").select("kb_id", "doc_id", document_hash(F.col("content")).alias("h"))
    one = d.groupBy("kb_id", "h").agg(F.min("doc_id").alias("kept"), F.count("*").alias("n"))
    return one.groupBy("kb_id").agg(F.count("*").alias("kept"), F.sum(F.col("n") - 1).alias("dropped"), F.sum("kept").alias("kept_ids"))


def q_content_hash(spark: SparkSession, root: str) -> DataFrame:
    """Distinct content hashes of atoms per type."""
    a = table(spark, root, "atoms").where("text IS NOT NULL")
    return a.groupBy("type").agg(F.count_distinct(content_hash(F.col("text"))).alias("n"), F.count("*").alias("atoms"))


def q_sentence_split(spark: SparkSession, root: str) -> DataFrame:
    """Sentences of every chunk and the characters of the longest."""
    c = table(spark, root, "chunks").where("text IS NOT NULL").select("chunk_id", sentences(F.col("text")).alias("s")).distinct()
    return c.select("chunk_id", F.size("s").alias("n"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).alias("longest"))


def q_normalized_query(spark: SparkSession, root: str) -> DataFrame:
    """Normal forms of file names, with how many share each."""
    d = table(spark, root, "documents").where("filename IS NOT NULL")
    return d.groupBy(normalized_query(F.col("filename")).alias("form")).agg(F.count("*").alias("n"))


def q_normalized_name(spark: SparkSession, root: str) -> DataFrame:
    """Keys of section titles, with how many atoms have each."""
    a = table(spark, root, "atoms").where("context IS NOT NULL").groupBy("context").agg(F.count("*").alias("m"))
    return a.groupBy(normalized_name(F.col("context")).alias("name_norm")).agg(F.sum("m").alias("n"))


def q_table_header(spark: SparkSession, root: str) -> DataFrame:
    """Headers of table atoms, by their hash."""
    a = table(spark, root, "atoms").where("type = 'table' AND text IS NOT NULL").dropDuplicates(["atom_id", "text"])
    return a.select("atom_id", F.md5(table_header(F.col("text"))).alias("header"))


def q_confidence(spark: SparkSession, root: str) -> DataFrame:
    """Confidence stated at the end of descriptions made of file names and sizes."""
    d = table(spark, root, "documents").where("filename IS NOT NULL")
    said = F.concat(F.col("filename"), F.lit("\nConfidence: 0."), F.pmod(F.col("n_chars"), F.lit(100)).cast("string"))
    t = F.when(F.pmod(F.col("n_chars"), F.lit(3)) == 0, F.col("filename")).otherwise(said)
    return d.select("doc_id", confidence(t).alias("confidence"), F.length(without_confidence(t)).alias("chars"))


def q_identifiers(spark: SparkSession, root: str) -> DataFrame:
    """File names as identifiers."""
    d = table(spark, root, "documents").where("filename IS NOT NULL")
    return d.groupBy(F.regexp_replace("filename", "[^0-9A-Za-z_]", "_").alias("name")).agg(F.count("*").alias("n"))


def q_first_line(spark: SparkSession, root: str) -> DataFrame:
    """The first non-empty line of every document, 200 characters at most."""
    d = table(spark, root, "documents").where("text IS NOT NULL")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return d.select("doc_id", F.md5(F.substring(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), 1, 200)).alias("line"))


def q_formula_lines(spark: SparkSession, root: str) -> DataFrame:
    """Formula atoms with the dollar signs around them taken off."""
    a = table(spark, root, "atoms").where("type = 'formula' AND text IS NOT NULL").dropDuplicates(["atom_id", "text"])
    t = F.trim("text")
    two = F.startswith(t, F.lit("$$")) & F.endswith(t, F.lit("$$")) & (F.length(t) > 4)
    one = F.startswith(t, F.lit("$")) & F.endswith(t, F.lit("$")) & (F.length(t) > 2)
    body = F.when(two, F.substring(t, F.lit(3), F.length(t) - 4)).when(one, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    return a.select("atom_id", F.trim(body).alias("latex"))


def q_char_grams(spark: SparkSession, root: str) -> DataFrame:
    """How often each character trigram occurs in file names."""
    d = table(spark, root, "documents").where("filename IS NOT NULL")
    return d.select(F.explode(char_grams(F.col("filename"), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def hash_embedding(df: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """``key``, dim_no, value: the signed feature hashing of character 2-, 3- and 4-grams, of unit length.

    Sparse: zero dimensions have no row; a text without grams, or whose signs cancel, is 1 at 0.
    """
    t = stripped(F.col(text))
    rows = df.where(F.col(text).isNotNull()).select(key, t.alias("_t"))
    grams = F.concat(*[char_grams(F.col("_t"), n) for n in (2, 3, 4)])
    g = rows.select(key, F.explode(grams).alias("g")).groupBy(key, "g").agg(F.count("*").alias("n")).withColumn("h", rolling_hash(F.col("g")))
    sign = F.when(F.shiftright("h", 16).bitwiseAND(F.lit(1)) == 1, F.col("n")).otherwise(-F.col("n"))
    cells = g.groupBy(key, F.pmod("h", F.lit(dim)).cast("int").alias("dim_no")).agg(F.sum(sign).alias("v")).where("v <> 0")
    norm = cells.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    full = cells.join(norm, key).select(key, "dim_no", (F.col("v") / F.col("norm")).alias("value"))
    none = rows.select(key).distinct().join(norm, key, "left_anti").select(key, F.lit(0).alias("dim_no"), F.lit(1.0).alias("value"))
    return full.unionByName(none)


def q_hash_embedding(spark: SparkSession, root: str) -> DataFrame:
    """Feature-hash vectors of file names."""
    return hash_embedding(table(spark, root, "documents"), "doc_id", "filename").withColumn("value", F.round("value", 6))


def q_triplets(spark: SparkSession, root: str) -> DataFrame:
    """Triplets parsed from marked text made of atom contexts."""
    a = table(spark, root, "atoms").where("context IS NOT NULL AND NOT contains(context, '<')").select("context", "type").distinct()
    marked = F.concat(F.lit("<triplet> "), F.col("context"), F.lit(" <subj> "), F.col("type"), F.lit(" <obj> kind"))
    return a.select(F.explode(parsed_triplets(marked)).alias("x")).select(F.col("x.head").alias("head"), F.col("x.tail").alias("tail"))


def q_json_block(spark: SparkSession, root: str) -> DataFrame:
    """Numbers from the JSON objects in event properties, cut out of fenced text and read by schema."""
    e = table(spark, root, "events")
    said = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```"))
    block = F.regexp_extract(said, "(?s)(\\{.*\\})", 1)
    return e.select(F.from_json(block, "k int").alias("x")).groupBy(F.col("x.k").alias("k")).agg(F.count("*").alias("n"))


def q_metadata_json(spark: SparkSession, root: str) -> DataFrame:
    """Open metadata merged with an update and counted by key and value."""
    d = table(spark, root, "documents").where("metadata IS NOT NULL")
    keys = F.array_union(F.map_keys("metadata"), F.array(F.lit("reviewed")))
    merged = F.map_from_arrays(keys, F.transform(keys, lambda k: F.when(k == "reviewed", F.lit("yes")).otherwise(F.col("metadata")[k])))
    return d.select(F.explode(merged).alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("n"))


QUERIES = {
    "token_count": q_token_count, "document_hash": q_document_hash, "document_dedup": q_document_dedup, "content_hash": q_content_hash, "sentence_split": q_sentence_split,
    "normalized_query": q_normalized_query, "normalized_name": q_normalized_name, "table_header": q_table_header, "confidence_parse": q_confidence, "identifiers": q_identifiers,
    "first_line": q_first_line, "formula_lines": q_formula_lines, "char_grams": q_char_grams, "hash_embedding": q_hash_embedding, "triplet_parse": q_triplets, "json_block": q_json_block, "metadata_merge": q_metadata_json,
}

WIDE = "[\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{ff00}-\\x{ffef}]"


def tokens_sql(c: str) -> str:
    """The token heuristic in DuckDB."""
    wide = f"(length({c}) - length(regexp_replace({c}, '{WIDE}', '', 'g')))"
    return f"(CASE WHEN length({c}) = 0 THEN 0 ELSE greatest(1, len(regexp_extract_all({c}, '[A-Za-z0-9_`]+')) + (length(regexp_replace({c}, '[A-Za-z0-9_`]+', '', 'g')) - {wide}) // 4 + {wide}) END)"


def strip_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"


_GRAMS = " UNION ALL ".join(
    f"SELECT doc_id, unnest(CASE WHEN length(t) = 0 THEN [] WHEN length(t) < {n} THEN [t] ELSE list_transform(range(1, length(t) - {n} + 2), lambda i: substring(t, i, {n})) END) AS g FROM x" for n in (2, 3, 4)
)
_SAID = "CASE WHEN n_chars % 3 = 0 THEN filename ELSE filename || chr(10) || 'Confidence: 0.' || CAST(n_chars % 100 AS VARCHAR) END"
ORACLE = {
    "token_count": f"SELECT DISTINCT chunk_id, CAST({tokens_sql('text')} AS INTEGER) AS tokens, CAST(token_count - {tokens_sql('text')} AS INTEGER) AS off FROM (SELECT chunk_id, text, min(token_count) AS token_count FROM chunks WHERE chunk_id IS NOT NULL GROUP BY ALL)",
    "document_hash": "SELECT kb_id, count(*) AS n, count(*) AS same FROM documents WHERE content IS NOT NULL AND doc_hash IS NOT NULL GROUP BY 1",
    "document_dedup": "SELECT kb_id, count(*) AS kept, sum(n - 1) AS dropped, sum(k) AS kept_ids FROM (SELECT kb_id, doc_hash, min(doc_id) AS k, count(*) AS n FROM documents WHERE content IS NOT NULL AND doc_hash IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "content_hash": f"SELECT type, count(DISTINCT sha256({strip_sql('text')})) AS n, count(*) AS atoms FROM atoms WHERE text IS NOT NULL GROUP BY 1",
    "sentence_split": f"""SELECT chunk_id, len(s) AS n, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM (SELECT DISTINCT chunk_id,
list_filter(string_split(regexp_replace({strip_sql('text')}, '([。！？!?；;])', '\\1' || chr(31), 'g'), chr(31)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '') AS s FROM chunks WHERE text IS NOT NULL)""",
    "normalized_query": f"""SELECT array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(filename), '[-_/]', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 1 AND w NOT IN ({", ".join(repr(w) for w in STOPWORDS)})), ' ') AS form, count(*) AS n
FROM documents WHERE filename IS NOT NULL GROUP BY 1""",
    "table_header": f"""SELECT DISTINCT atom_id, md5(CASE WHEN len(l) >= 2 AND contains(l[1], '|') AND regexp_full_match({strip_sql('l[2]')}, '[|\\-: ]*') THEN l[1] || chr(10) || l[2] ELSE '' END) AS header
FROM (SELECT atom_id, string_split({strip_sql('text')}, chr(10)) AS l FROM atoms WHERE type = 'table' AND text IS NOT NULL)""",
    "confidence_parse": f"""SELECT doc_id, CASE WHEN c = '' THEN 0.5 ELSE least(1.0, CAST(c AS DOUBLE)) END AS confidence, length({strip_sql("regexp_replace(t, '(?i)confidence\\s*:\\s*(0?\\.\\d+|1\\.0+)', '')")}) AS chars
FROM (SELECT doc_id, {_SAID} AS t, regexp_extract({_SAID}, '(?i)confidence\\s*:\\s*(0?\\.\\d+|1\\.0+)', 1) AS c FROM documents WHERE filename IS NOT NULL)""",
    "identifiers": "SELECT regexp_replace(filename, '[^0-9A-Za-z_]', '_', 'g') AS name, count(*) AS n FROM documents WHERE filename IS NOT NULL GROUP BY 1",
    "first_line": "SELECT doc_id, md5(substring(coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], ''), 1, 200)) AS line FROM documents WHERE text IS NOT NULL",
    "formula_lines": """SELECT DISTINCT atom_id, trim(CASE WHEN t LIKE '$$%$$' AND length(t) > 4 THEN substring(t, 3, length(t) - 4) WHEN t LIKE '$%$' AND length(t) > 2 THEN substring(t, 2, length(t) - 2) ELSE t END) AS latex
FROM (SELECT atom_id, trim(text) AS t FROM atoms WHERE type = 'formula' AND text IS NOT NULL)""",
    "char_grams": f"WITH x AS (SELECT {strip_sql('filename')} AS t FROM documents WHERE filename IS NOT NULL) SELECT g AS gram, count(*) AS n FROM (SELECT unnest(CASE WHEN length(t) = 0 THEN [] WHEN length(t) < 3 THEN [t] ELSE list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)) END) AS g FROM x) GROUP BY 1",
    "hash_embedding": f"""WITH x AS (SELECT doc_id, {strip_sql('filename')} AS t FROM documents WHERE filename IS NOT NULL), g AS ({_GRAMS}),
h AS (SELECT doc_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(g, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: (a * 131 + b) & 4294967295) AS h FROM g),
c AS (SELECT doc_id, CAST(h % 256 AS INTEGER) AS dim_no, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h GROUP BY 1, 2 HAVING v <> 0),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM c GROUP BY 1)
SELECT doc_id, dim_no, round(v / norm, 6) AS value FROM c JOIN n USING (doc_id) UNION ALL SELECT doc_id, 0, 1.0 FROM x WHERE doc_id NOT IN (SELECT doc_id FROM n)""",
    "triplet_parse": "SELECT DISTINCT trim(context) AS head, type AS tail FROM atoms WHERE context IS NOT NULL AND NOT contains(context, '<')",
    "json_block": "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1",
    "metadata_merge": """SELECT key, value, count(*) AS n FROM (SELECT unnest(map_entries(metadata)).key AS key, unnest(map_entries(metadata)).value AS value FROM documents WHERE metadata IS NOT NULL
UNION ALL SELECT 'reviewed', 'yes' FROM documents WHERE metadata IS NOT NULL) GROUP BY ALL""",
}
