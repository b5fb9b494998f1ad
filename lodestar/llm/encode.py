"""Encoding of a whole corpus, and token counts, with a public byte-level BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.byte_bpe import DEFAULT_VOCABULARY, Encoder, parse_ranks


def _encoder(content) -> Encoder:
    return Encoder(parse_ranks(content.value))


def encoded(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every row; ids is empty for an empty or NULL text. Repeated rows stay repeated.

    ``vocabulary`` is read on the driver and sent to the tasks; a vocabulary has a fixed size of about a megabyte.
    """
    spark = documents.sparkSession
    content = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    kind = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content)
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return documents.select(id_column, text_column).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_counts(rows: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, text_column: str = "text") -> DataFrame:
    """``rows`` with their text replaced by ``n_tokens`` (0 for empty and NULL texts); other columns stay."""
    spark = rows.sparkSession
    content = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    others = [f for f in rows.schema.fields if f.name != text_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content)
        for batch in batches:
            n = [len(encoder.encode(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], names=[*[f.name for f in others], "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return rows.select(text_column, *[f.name for f in others]).mapInArrow(run, schema + ", n_tokens bigint")
