"""Per-key figures when a few keys hold most rows.

Each input split encodes its own keys as a dictionary and counts them in a dense array (``numpy.bincount``), so a
key takes one entry per split, however many rows it has. The dictionary is divided into blocks by a hash of the key;
every split sends its slice of each block, and the slices of a block are scattered into one dense array and summed.
The work of a reducer thus depends on how many different keys its block has, never on how often a key occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import normalise_url
from lodestar.session import shuffle_width

FLUSH_AT = 1 << 19
KEYS_PER_BLOCK = 250_000
_SLICES = "side string, block int, keys array<string>, counts array<bigint>"


def _merged(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """One dictionary for several, their arrays scatter-added. Sums are exact below 2**53."""
    coded = pa.concat_arrays([keys for keys, _ in parts]).dictionary_encode()
    counts = np.bincount(coded.indices.to_numpy(), weights=np.concatenate([c for _, c in parts]), minlength=len(coded.dictionary))
    return coded.dictionary, counts.astype(np.int64)


def _split_counter(sides: list[str], blocks: int):
    def slices(side: str, parts: list) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        keys, counts = _merged(parts)
        if not len(keys):
            return
        block = (pd.util.hash_array(keys.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(blocks)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        present, starts = np.unique(block[order], return_index=True)
        offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([side] * len(present), pa.string()),
                pa.array(present, pa.int32()),
                pa.ListArray.from_arrays(offsets, keys.take(pa.array(order))),
                pa.ListArray.from_arrays(offsets, pa.array(counts[order])),
            ],
            names=["side", "block", "keys", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {s: [] for s in sides}
        size = dict.fromkeys(sides, 0)
        for batch in batches:
            for side in sides:
                coded = batch.column(batch.schema.get_field_index(side)).drop_null().dictionary_encode()
                held[side].append((coded.dictionary, np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))))
                size[side] += len(coded.dictionary)
                if size[side] > FLUSH_AT:
                    held[side] = [_merged(held[side])]
                    size[side] = len(held[side][0][0])
                    if size[side] > FLUSH_AT // 2:
                        yield from slices(side, held[side])
                        held[side], size[side] = [], 0
        for side in sides:
            yield from slices(side, held[side])

    return run


def _sum_block(key: tuple, table: pa.Table) -> pa.Table:
    parts = [
        (k, c)
        for keys, counts in zip(table["keys"].chunks, table["counts"].chunks, strict=True)
        for k, c in [(keys.flatten(), counts.flatten().to_numpy())]
    ]
    keys, counts = _merged(parts)
    return pa.table({"side": pa.array([key[0].as_py()] * len(keys), pa.string()), "key": keys, "n": counts})


def key_counts(df: DataFrame, sides: dict[str, Column], blocks: int | None = None) -> DataFrame:
    """``(side, key, n)``: how many rows hold ``key`` in the column that ``sides`` names ``side``.

    NULL is no key; the empty string is one. Repeated rows count each. An empty table gives no rows. Other columns,
    whatever their names, aren't read. ``blocks`` bounds what one reducer holds (1/blocks of the different keys); their
    number follows an estimate of the different keys.
    """
    named = df.select(*[c.cast("string").alias(s) for s, c in sides.items()])
    blocks = blocks or blocks_for(named, list(sides))
    slices = named.mapInArrow(_split_counter(list(sides), blocks), _SLICES)
    return slices.groupBy("side", "block").applyInArrow(_sum_block, "side string, key string, n bigint")


def blocks_for(named: DataFrame, sides: list[str]) -> int:
    """Blocks for a table of keys: at least four for each task of a shuffle, and about KEYS_PER_BLOCK different keys in each."""
    least = 4 * shuffle_width(named.sparkSession)
    if named.count() <= least * KEYS_PER_BLOCK:  # there can't be more keys than rows
        return least
    keys = max(named.agg(*[F.approx_count_distinct(s).alias(s) for s in sides]).first())
    return max(least, 1 + keys // KEYS_PER_BLOCK)


def url_degrees(edges: DataFrame, blocks: int | None = None) -> DataFrame:
    """``(side, url, n_links, n_partners)`` of every URL on either side of a link table, URLs trimmed and in lower case.

    ``n_links`` counts all rows, repeated ones and those with a NULL partner too; ``n_partners`` counts the different
    URLs on the other side (0 if all are NULL). Pairs are made unique by both ends together, which spreads a hot URL.
    """
    ends = edges.select(normalise_url(F.col("src")).alias("src"), normalise_url(F.col("dst")).alias("dst"))
    blocks = blocks or blocks_for(ends, ["src", "dst"])
    links = key_counts(ends, {"src": F.col("src"), "dst": F.col("dst")}, blocks)
    pairs = ends.where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    partners = key_counts(pairs, {"src": F.col("src"), "dst": F.col("dst")}, blocks)
    return (
        links.select("side", F.col("key").alias("url"), F.col("n").alias("n_links"))
        .join(partners.select("side", F.col("key").alias("url"), F.col("n").alias("n_partners")), ["side", "url"], "left")
        .withColumn("n_partners", F.coalesce("n_partners", F.lit(0).cast("bigint")))
    )


def heavy_urls(edges: DataFrame, percent: int = 2, blocks: int | None = None) -> DataFrame:
    """``(side, url)``: URLs that stand in at least ``percent`` of all rows on that side."""
    counts = key_counts(edges, {"src": normalise_url(F.col("src")), "dst": normalise_url(F.col("dst"))}, blocks)
    total = edges.count()
    return counts.where(F.col("n") * 100 >= percent * total).select("side", F.col("key").alias("url"))
