"""Token counts by a public tokenizer.  Its vocabulary file is a parameter and is read where it is."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A file of ranks, one ``base64 rank`` pair a line; every executor must be able to read it.
VOCABULARY = os.environ.get("LODESTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the public pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoding(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(df: DataFrame, text: str, keep: tuple[str, ...], path: str = VOCABULARY) -> DataFrame:
    """The ``keep`` columns and ``tokens`` of every row; a null text has none (null), an empty one 0."""
    rows = df.select(*keep, F.col(text).alias("_t"))
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path)
        for b in batches:
            n = [None if t is None else len(e.encode_ordinary(t)) for t in b.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int32())], names=[*keep, "tokens"])

    return rows.mapInArrow(run, f"{kept}, tokens int")
