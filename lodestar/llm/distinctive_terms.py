"""How distinctive a term is for a page: Dunning's log-likelihood ratio on a two-by-two table.

The table of a (page, term) pair holds how often the term and all other terms stand in the page and in the rest of the
collection. A term that is as frequent in the page as elsewhere scores near 0, a rare term that the page repeats scores
high; terms that are rarer in the page than elsewhere get a negative sign.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.pages import one_per_id
from lodestar.session import cut_lineage

TERM = re.compile(r"\b[a-z]{3,}\b")
HELD_TERMS = 400_000
_ROWS = pa.schema([("term", pa.string()), ("doc_id", pa.string()), ("tf", pa.int64()), ("dl", pa.int64()), ("df", pa.int64()), ("cf", pa.int64())])
_BLOCKS = pa.schema([("block", pa.string()), ("term", pa.string()), ("at", pa.int32()), ("df", pa.int64()), ("cf", pa.int64()), ("packed", pa.binary())])
_SCORED = "doc_id string, term string, tf bigint, df bigint, llr double"


def terms(text: str | None) -> list[str]:
    """Maximal runs of letters, digits and underscores of the lower-cased text that are three or more letters a-z."""
    return TERM.findall(text.lower()) if text else []


def _count(min_tf: int, max_df: int):
    """Per task: terms with the pages and places they have there, and the (page, term) pairs worth a score.

    A term found in more than ``max_df`` pages of one task can't qualify, so its pairs stay in the task: no term sends
    more than ``max_df`` pairs per task, however common it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        cf: Counter = Counter()
        pairs: list[tuple[str, str, int, int]] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal total
            kept = [p for p in pairs if df[p[0]] <= max_df]
            known = list(df)
            n, m = len(kept), len(known)
            t, d, f, dl = zip(*kept, strict=True) if kept else ((), (), (), ())
            table = pa.table(
                [
                    pa.array([*t, *known, None], pa.string()),
                    pa.array([*d, *[None] * (m + 1)], pa.string()),
                    pa.array([*f, *[None] * (m + 1)], pa.int64()),
                    pa.array([*dl, *[None] * (m + 1)], pa.int64()),
                    pa.array([*[None] * n, *map(df.__getitem__, known), 0], pa.int64()),
                    pa.array([*[None] * n, *map(cf.__getitem__, known), total], pa.int64()),
                ],
                schema=_ROWS,
            )
            yield from table.to_batches(max_chunksize=50_000)
            df.clear(), cf.clear(), pairs.clear()
            total = 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms(text)
                if not found:
                    continue
                total += len(found)
                own = Counter(found)
                df.update(own.keys())
                cf.update(found)
                pairs.extend((t, doc_id, c, len(found)) for t, c in own.items() if c >= min_tf)
            if len(df) > HELD_TERMS or len(pairs) > HELD_TERMS:
                yield from flush()
        yield from flush()

    return run


def _pack(min_tf: int):
    """Blocks of pages: a row per term of the block with the pages and places it has there, and one row with all pairs.

    A block is named by its first page. Its pairs are packed as numbers: per page the places of its terms in the block's
    list of terms, and how often each stands there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: defaultdict = defaultdict()
        index.default_factory = index.__len__
        ids: list[str] = []
        lengths: list[int] = []
        at: list[list[int]] = []
        tf: list[list[int]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not ids:
                return
            flat = np.fromiter(chain.from_iterable(at), np.int32, held)
            often = np.fromiter(chain.from_iterable(tf), np.int64, held)
            m = len(index)
            df = np.bincount(flat, minlength=m)
            cf = np.bincount(flat, weights=often, minlength=m).astype(np.int64)
            page = np.repeat(np.arange(len(ids)), [len(x) for x in at])
            kept = often >= min_tf
            ends = np.r_[0, np.cumsum(np.bincount(page[kept], minlength=len(ids)))].astype(np.int32)
            pages = pa.record_batch(
                [
                    pa.array(ids, pa.string()),
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[kept])),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(often[kept])),
                ],
                names=["doc_id", "dl", "at", "tf"],
            )
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pages.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(pages)
            table = pa.table(
                [
                    pa.array([ids[0]] * (m + 1), pa.string()),
                    pa.array([*index, None], pa.string()),
                    pa.array([*range(m), None], pa.int32()),
                    pa.array([*df.tolist(), None], pa.int64()),
                    pa.array([*cf.tolist(), sum(lengths)], pa.int64()),
                    pa.array([*[None] * m, sink.getvalue().to_pybytes()], pa.binary()),
                ],
                schema=_BLOCKS,
            )
            yield from table.to_batches(max_chunksize=50_000)
            index.clear(), ids.clear(), lengths.clear(), at.clear(), tf.clear()
            held = 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms(text)
                if not found:
                    continue
                own = Counter(found)
                ids.append(doc_id)
                lengths.append(len(found))
                at.append(list(map(index.__getitem__, own)))
                tf.append(list(own.values()))
                held += len(own)
                if held > HELD_TERMS:
                    yield from flush()
        yield from flush()

    return run


def _llr(tf: np.ndarray, dl: np.ndarray, cf: np.ndarray, total: int) -> np.ndarray:
    """The same as log_likelihood, for arrays."""
    tf, dl, cf = (x.astype(np.float64) for x in (tf, dl, cf))
    cells = ((tf, dl, cf), (cf - tf, total - dl, cf), (dl - tf, dl, total - cf), (total - dl - (cf - tf), total - dl, total - cf))
    with np.errstate(divide="ignore", invalid="ignore"):
        g = sum(np.where(seen > 0, seen * np.log(seen * total / (row * column)), 0.0) for seen, row, column in cells)
    return 2 * np.where(tf * total >= dl * cf, g, -g)


def _unpack(total: int, top: int | None):
    """The pairs of one block with the counts and scores of their terms; of each page all, or the ``top`` best. Terms without counts are left out."""

    def run(packed: pa.Table, known: pa.Table) -> pa.Table:
        pages = pa.ipc.open_stream(packed["packed"][0].as_py()).read_next_batch()
        at, tf = (pages.column(k).flatten().to_numpy() for k in (2, 3))
        page = np.repeat(np.arange(len(pages)), np.diff(pages.column(2).offsets.to_numpy()))
        places = known["at"].to_numpy()
        row = np.full(max(at.max(initial=-1), places.max(initial=-1)) + 1, -1, np.int64)
        row[places] = np.arange(len(places))
        row = row[at]
        kept = row >= 0
        row, page, tf = row[kept], page[kept], tf[kept]
        llr = _llr(tf, pages.column(1).to_numpy()[page], known["cf"].to_numpy()[row], total)
        if top is not None:
            terms_ = known["term"].to_numpy()[row] if len(row) else np.zeros(0, object)
            order = np.lexsort((terms_, -np.round(llr, 6), page))
            page, row, tf, llr = page[order], row[order], tf[order], llr[order]
            first = np.arange(len(page)) - np.searchsorted(page, page, side="left") < top
            page, row, tf, llr = page[first], row[first], tf[first], llr[first]
        columns = [pages.column(0).take(pa.array(page)), known["term"].take(pa.array(row)), pa.array(tf), known["df"].take(pa.array(row)), pa.array(llr)]
        return pa.table(columns, names=["doc_id", "term", "tf", "df", "llr"])

    return run


def _all_pairs(pages: DataFrame, min_tf: int, min_df: int, top: int | None = None) -> DataFrame:
    """``(doc_id, term, tf, df, llr)`` of all pairs whose term stands in min_df pages or more, or of the best ``top`` of each page.

    Pairs never meet the counts of their terms one by one: the terms of a block of pages do, once per block, and go to
    where the block's pairs are opened. A term on every page thus has one row per block.
    """
    rows = one_per_id(pages).mapInArrow(_pack(min_tf), "block string, term string, at int, df bigint, cf bigint, packed binary")
    # written once: the counts and the pairs come from the same pass over the texts
    rows = cut_lineage(rows)
    total = rows.where("packed IS NOT NULL").agg(F.coalesce(F.sum("cf"), F.lit(0))).first()[0]
    own = rows.where("term IS NOT NULL").select("block", "term", "at", "df", "cf")
    stats = own.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where(F.col("df") >= min_df)
    known = own.select("block", "term", "at").join(stats, "term").select(F.col("block").alias("of"), "term", "at", "df", "cf")
    packed = rows.where("packed IS NOT NULL").select("block", "packed")
    # a block none of whose terms is known, or without pairs, gives no rows
    return packed.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_unpack(total, top), _SCORED)


def top_terms(pages: DataFrame, top: int = 10, min_df: int = 2) -> DataFrame:
    """``(doc_id, place, term, llr)``: the ``top`` most characteristic terms of each page, ties of the score (at six decimals) by term.

    Terms of a single page, mostly misspellings, are left out by ``min_df``; common terms take part with the little they score.
    """
    rows = _all_pairs(pages, 1, min_df, top)
    order = Window.partitionBy("doc_id").orderBy(F.round("llr", 6).desc(), "term")  # at most ``top`` rows of a page
    return rows.select("doc_id", F.row_number().over(order).alias("place"), "term", "llr")


def log_likelihood(tf: Column, dl: Column, cf: Column, total: Column) -> Column:
    """Signed log-likelihood ratio of a term that stands tf times in a page of dl terms, cf times in all ``total``."""
    tf, dl, cf, total = (c.cast("double") for c in (tf, dl, cf, total))
    a, b, c, d = tf, cf - tf, dl - tf, total - dl - (cf - tf)

    def cell(seen: Column, row: Column, column: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * total / (row * column))).otherwise(0.0)

    g = cell(a, dl, cf) + cell(b, total - dl, cf) + cell(c, dl, total - cf) + cell(d, total - dl, total - cf)
    return 2 * F.when(tf * total >= dl * cf, g).otherwise(-g)


def distinctive_terms(pages: DataFrame, min_tf: int = 1, min_df: int = 1, max_df: int | None = None) -> DataFrame:
    """``(doc_id, term, tf, df, llr)`` of the terms that stand at least min_tf times in a page and in min_df to max_df pages.

    Statistics cover all pages, each doc_id once; NULL, empty and blank texts have no terms. With no ``max_df`` the
    pairs stay packed by blocks of pages and only the terms of each block are joined with their counts.
    """
    if max_df is None:
        return _all_pairs(pages, min_tf, min_df)
    rows = one_per_id(pages).mapInArrow(
        _count(min_tf, max_df), "term string, doc_id string, tf bigint, dl bigint, df bigint, cf bigint"
    )
    # written once: the statistics and the pairs come from the same pass over the texts
    rows = cut_lineage(rows.where("doc_id IS NOT NULL OR cf > 0"))
    stats = rows.where("doc_id IS NULL AND term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    stats = stats.where(F.col("df").between(min_df, max_df))
    total = rows.where("doc_id IS NULL AND term IS NULL").agg(F.coalesce(F.sum("cf"), F.lit(0))).first()[0]
    pairs = rows.where("doc_id IS NOT NULL").select("term", "doc_id", "tf", "dl")
    return _scored(pairs.join(stats, "term"), total)


def _scored(pairs: DataFrame, total: int) -> DataFrame:
    return pairs.select(
        "doc_id", "term", "tf", "df", log_likelihood(F.col("tf"), F.col("dl"), F.col("cf"), F.lit(total)).alias("llr")
    )
