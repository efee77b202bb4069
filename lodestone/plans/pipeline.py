"""Whole pipelines as plans: documents to chunks, questions to answers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import token_count
from lodestone.operators.ingest import ChunkOptions, ParseOptions, chunk, parse
from lodestone.operators.predicate import compile_filter
from lodestone.operators.search import BUDGET, assemble, fuse_ranks, overlap_rerank, phrase_bm25, token_bm25
from lodestone.operators.texts import document_hash
from lodestone.plans.session import materialize


@dataclass(frozen=True)
class SearchOptions:
    top_k: int = 20
    rerank_top: int = 8
    budget: int = BUDGET
    filter: dict | None = None
    routes: tuple[str, ...] = field(default=("bm25", "phrase"))


def ingest(docs: DataFrame, parse_options: ParseOptions = ParseOptions(), chunk_options: ChunkOptions = ChunkOptions()) -> dict[str, DataFrame]:  # noqa: B008
    """``atoms``, ``chunks``, ``rejects`` and ``tasks`` of documents: copies (equal hash in a knowledge base) are taken once.

    Stages are written in between, so that a later stage starts from tables.
    """
    hashed = docs.withColumn("_h", F.coalesce(document_hash(F.col("content")), F.sha2(F.coalesce("text", F.lit("")), 256)))
    first = hashed.groupBy("kb_id", "_h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    taken = hashed.join(first, "doc_id", "left_semi").drop("_h")
    atoms, refused = parse(taken, parse_options)
    atoms = materialize(atoms, "atoms")
    chunks, large = chunk(atoms, chunk_options)
    chunks = materialize(chunks.join(taken.select("doc_id", "kb_id"), "doc_id"), "chunks")
    rejects = refused.select("doc_id", F.lit(None).cast("string").alias("chunk_id"), "code").unionByName(large.select("doc_id", "chunk_id", "code"))
    status = taken.select("doc_id").join(rejects.where("code = 2002").select("doc_id", "code").distinct(), "doc_id", "left")
    tasks = status.select("doc_id", F.when(F.col("code").isNotNull(), "failed").otherwise("done").alias("status"), "code")
    return {"atoms": atoms, "chunks": chunks, "rejects": rejects, "tasks": tasks}


def search(queries: DataFrame, chunks: DataFrame, o: SearchOptions = SearchOptions()) -> DataFrame:  # noqa: B008
    """query_id, chunk_id, score, sources, rank, text, token_count: all queries in one plan, routes fused and reranked."""
    docs = chunks.where(compile_filter(o.filter, chunks)) if o.filter else chunks
    corpus = docs.select(F.col("chunk_id").alias("doc_id"), "text")
    found = {"bm25": token_bm25, "phrase": phrase_bm25}
    hits = None
    for r in o.routes:
        one = found[r](queries, corpus, o.top_k).select("query_id", F.col("doc_id").alias("chunk_id"), "rank", F.lit("bm25" if r == "bm25" else "dense").alias("route"))
        hits = one if hits is None else hits.unionByName(one)
    fused = fuse_ranks(hits)
    top = overlap_rerank(fused, queries, docs.select("chunk_id", "text"), top=o.rerank_top)
    return top.select("query_id", "chunk_id", "score", "sources", F.col("new_rank").alias("rank"), "text", token_count(F.col("text")).alias("token_count"))


def answer(queries: DataFrame, chunks: DataFrame, o: SearchOptions = SearchOptions()) -> DataFrame:  # noqa: B008
    """query_id, context, citations (chunk ids in order), degraded: the context that a model would be given.

    A query without a hit has an empty context and says so.
    """
    kept = assemble(search(queries, chunks, o), o.budget)
    rows = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text")))
    made = kept.groupBy("query_id").agg(rows.alias("r"))
    made = made.select("query_id", F.array_join(F.transform("r", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["text"])), "\n\n").alias("context"), F.transform("r", lambda x: x["chunk_id"]).alias("citations"))
    out = queries.select("query_id").join(made, "query_id", "left")
    return out.select("query_id", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("citations", F.array().cast("array<string>")).alias("citations"), F.col("context").isNull().alias("degraded"))
