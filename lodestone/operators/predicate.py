"""The filter language: ``{"and": [clause...], "or": [clause...]}`` compiled to a Column.

A clause is ``{field, op, value}``.  All of ``and`` and one of ``or`` must hold.  A null or absent
field satisfies no clause, ``ne`` included.  Fields that are no columns are keys of ``metadata``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.tables import table

# Operators and their other spellings.
OPS = {"eq", "ne", "gt", "ge", "lt", "le", "in", "contains"}
SPELLINGS = {">=": "ge", "<=": "le", ">": "gt", "<": "lt", "=": "eq", "==": "eq", "!=": "ne", "<>": "ne"}
BAD_FILTER = 4003


class FilterError(ValueError):
    """An expression that is not of the language; ``code`` is the numeric error."""

    code = BAD_FILTER


def operator(op: str) -> str:
    """The canonical name of an operator."""
    name = SPELLINGS.get(op, op)
    if name not in OPS:
        raise FilterError(f"unknown operator {op!r}")
    return name


def validate(expr: dict | None) -> dict[str, list[tuple[str, str, object]]]:
    """Clauses by group, operators made canonical; raises :class:`FilterError`."""
    out: dict[str, list] = {"and": [], "or": []}
    if expr is None:
        return out
    if not isinstance(expr, dict) or set(expr) - set(out):
        raise FilterError("a filter has the groups and, or")
    for group, clauses in expr.items():
        for c in clauses or []:
            if not isinstance(c, dict) or not c.get("field"):
                raise FilterError("a clause needs a field")
            if not c.get("op"):
                raise FilterError("a clause needs an operator")
            op = operator(str(c["op"]))
            value = c.get("value")
            if op == "in" and not isinstance(value, list | tuple):
                raise FilterError("in needs a list")
            out[group].append((str(c["field"]), op, value))
    return out


def field(name: str, columns: list[str]) -> Column:
    """The column of that name, or the key of the open map ``metadata``."""
    return F.col(name) if name in columns else F.col("metadata")[name.removeprefix("metadata.")]


def clause(c: Column, op: str, value: object, kind: T.DataType | None = None) -> Column:
    """One comparison: text for eq, ne and in; numbers for ranges; substring without ASCII case for contains."""
    if op in ("gt", "ge", "lt", "le"):
        n = c.try_cast("double")
        v = F.lit(float(value))
        return {"gt": n > v, "ge": n >= v, "lt": n < v, "le": n <= v}[op]
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    # on a string column the bare comparison reaches the scan
    s = c if isinstance(kind, T.StringType) else c.cast("string")
    if op == "in":
        return s.isin(*[text(v) for v in value])
    if op == "contains":
        return F.contains(F.lower(s), F.lit(str(value).lower()))
    return s == text(value) if op == "eq" else s != text(value)


def compile_filter(expr: dict | None, df: DataFrame) -> Column:
    """The predicate over ``df``."""
    groups = validate(expr)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    one = lambda x: clause(field(x[0], df.columns), x[1], x[2], kinds.get(x[0]))
    out = F.lit(True)
    if groups["and"]:
        out = reduce(lambda a, b: a & b, map(one, groups["and"]))
    if groups["or"]:
        out = out & reduce(lambda a, b: a | b, map(one, groups["or"]))
    return out


def may_read(acl: Column, kb_id: Column) -> Column:
    """An empty or missing access list is no restriction."""
    return F.when(acl.isNull() | (F.size(acl) == 0), F.lit(True)).otherwise(F.array_contains(acl, kb_id))


def _query(expr: dict, name: str, key: str):  # noqa: ANN202
    def run(spark: SparkSession, root: str) -> DataFrame:
        df = table(spark, root, name)
        return df.where(compile_filter(expr, df)).groupBy(key).agg(F.count("*").alias("n"))

    run.__doc__ = f"Rows of {name} that pass a filter, per {key}."
    return run


def acl_filter(spark: SparkSession, root: str) -> DataFrame:
    """Documents that a tenant may read: its list is the knowledge bases it has calls in, if they are few."""
    acls = table(spark, root, "cost_records").where("tenant_id IS NOT NULL").groupBy("tenant_id").agg(F.array_sort(F.collect_set("kb_id")).alias("kbs"))
    acls = acls.select("tenant_id", F.when(F.size("kbs") <= 30, F.col("kbs")).alias("acl"))
    per_kb = table(spark, root, "documents").groupBy("kb_id").agg(F.count("*").alias("docs"))
    all_docs = table(spark, root, "documents").count()
    few = acls.where("acl IS NOT NULL").select("tenant_id", F.explode("acl").alias("kb_id")).join(per_kb, "kb_id", "left").groupBy("tenant_id").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n_docs"))
    every = acls.where("acl IS NULL").select("tenant_id", F.lit(all_docs).cast("bigint").alias("n_docs"))
    return few.unionByName(every)


QUERIES = {
    "filter_eq": _query({"and": [{"field": "lang", "op": "==", "value": "en"}]}, "documents", "source"),
    "filter_ne": _query({"and": [{"field": "source", "op": "!=", "value": "wiki"}]}, "documents", "lang"),
    "filter_range": _query({"and": [{"field": "n_chars", "op": ">=", "value": 500}, {"field": "n_chars", "op": "lt", "value": 5000}]}, "documents", "mimetype"),
    "filter_in": _query({"and": [{"field": "stage", "op": "in", "value": ["parsing", "chunking"]}]}, "checkpoints", "stage"),
    "filter_contains": _query({"and": [{"field": "text", "op": "contains", "value": "Retrieval GATEWAY"}]}, "chunks", "kb_id"),
    "filter_metadata": _query({"and": [{"field": "parser", "op": "eq", "value": "ocr"}, {"field": "metadata.tag", "op": "ne", "value": "draft"}]}, "documents", "mimetype"),
    "filter_and_or": _query({"and": [{"field": "version", "op": ">", "value": 0}], "or": [{"field": "edited", "op": "eq", "value": True}, {"field": "page", "op": "ge", "value": 3}]}, "chunks", "kb_id"),
    "cache_rows_excluded": _query({"and": [{"field": "doc_id", "op": "ne", "value": "__semantic_cache__"}]}, "chunks", "kb_id"),
    "acl_filter": acl_filter,
}
ORACLE = {
    "filter_eq": "SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source",
    "filter_ne": "SELECT lang, count(*) AS n FROM documents WHERE source <> 'wiki' GROUP BY lang",
    "filter_range": "SELECT mimetype, count(*) AS n FROM documents WHERE n_chars >= 500 AND n_chars < 5000 GROUP BY mimetype",
    "filter_in": "SELECT stage, count(*) AS n FROM checkpoints WHERE stage IN ('parsing', 'chunking') GROUP BY stage",
    "filter_contains": "SELECT kb_id, count(*) AS n FROM chunks WHERE contains(lower(text), 'retrieval gateway') GROUP BY kb_id",
    "filter_metadata": "SELECT mimetype, count(*) AS n FROM documents WHERE metadata['parser'] = 'ocr' AND metadata['tag'] <> 'draft' GROUP BY mimetype",
    "filter_and_or": "SELECT kb_id, count(*) AS n FROM chunks WHERE version > 0 AND (edited OR page >= 3) GROUP BY kb_id",
    "cache_rows_excluded": "SELECT kb_id, count(*) AS n FROM chunks WHERE CAST(doc_id AS VARCHAR) <> '__semantic_cache__' GROUP BY kb_id",
    "acl_filter": """WITH a AS (SELECT tenant_id, list(DISTINCT kb_id) AS kbs FROM cost_records WHERE tenant_id IS NOT NULL GROUP BY 1)
SELECT tenant_id, CAST(count(d.doc_id) AS BIGINT) AS n_docs FROM a LEFT JOIN documents d ON len(kbs) > 30 OR list_contains(kbs, d.kb_id) GROUP BY 1""",
}
