"""Lines that many pages of one site repeat, found by content-defined chunks.

The text of a page is normalised, line ends being blanks like any other, and cut where a rolling (gear) hash of the last
16 bytes meets a mask. Cuts depend on content alone, so equal passages give equal chunks wherever they stand and however
they are wrapped. The pages of a site that hold a chunk are counted, and chunks on too many of them are cut.
``repeated_passages`` returns the lines that consist of such chunks. ``repeated_lines`` asks for equal whole lines: a
line that holds a chunk which isn't repeated can't be one, so the others are the candidates, and an exact count of the
candidates decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.pages import kept_pages
from lodestar.session import cut_lineage, join_by_weight

WINDOW = 16
CUT_BITS = 5  # a chunk has 2**5 bytes on average
LEAST_PAGES = 8
SHARE_OF = 4
_DIGITS = re.compile(r"[0-9]+")
_AT_ONCE = 1 << 20


def normalised(line: str) -> str:
    """Equal for lines that differ only in case, outer or inner white space, or the value of runs of digits."""
    return " ".join(_DIGITS.sub("0", line.casefold()).split())


def _table(seed: int) -> np.ndarray:
    """256 scrambled 64-bit numbers, by the splitmix64 rule."""
    with np.errstate(over="ignore"):
        z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class Chunker:
    """Cuts many lines at once."""

    def __init__(self) -> None:
        self.gear = _table(1).astype(np.uint32)
        self.value = _table(2)
        self.base = np.uint64(0x9E3779B97F4A7C15 | 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.power = self.back = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            ones = np.full(n, self.base, np.uint64)
            ones[0] = 1
            self.power = np.cumprod(ones)
            ones[1:] = self.inverse
            self.back = np.cumprod(ones)

    def _hashes(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (prefix[end] - prefix[start]) * self.back[start] + (end - start).astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(32))).view(np.int64)

    def cut(self, pages: list[list[bytes]]) -> Cuts:
        """Cut pages of normalised lines that aren't blank."""
        count = np.fromiter(map(len, pages), np.int64, len(pages))
        lines = [x for page in pages for x in page]
        length = np.fromiter(map(len, lines), np.int64, len(lines))
        data = np.frombuffer(b" ".join(lines), np.uint8)
        n = len(data)
        end = np.cumsum(length + 1) - 1
        start = end - length
        last = np.cumsum(count)[count > 0] - 1
        page_end = end[last]
        page_start = start[last - count[count > 0] + 1]
        with np.errstate(over="ignore"):
            self._powers(n)
            prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(self.value[data] * self.power[:n], out=prefix[1:])
            h = self.gear[data]
            k = 1
            while k < WINDOW:
                wider = h.copy()
                wider[k:] += h[:-k] << np.uint32(k)
                h = wider
                k *= 2
            at = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
            of = np.minimum(np.searchsorted(page_end, at, side="left"), max(0, len(page_end) - 1))
            at = at[(at - page_start[of] >= WINDOW) & (at < page_end[of])] if len(at) else at
            ends = np.union1d(at, page_end)
            of = np.searchsorted(page_end, ends, side="left")
            starts = np.maximum(np.r_[0, ends[:-1]], page_start[of])
            per_page = np.zeros(len(pages), np.int64)
            per_page[count > 0] = np.bincount(of, minlength=len(page_end))
            return Cuts(count, start, end, self._hashes(prefix, start, end), starts, ends, self._hashes(prefix, starts, ends), per_page, np.isin(ends, page_end))


@dataclass
class Cuts:
    """Lines per page; start, end and hash of each line and of each chunk; chunks per page, and those that end with their page."""

    count: np.ndarray
    start: np.ndarray
    end: np.ndarray
    line: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    chunk: np.ndarray
    per_page: np.ndarray
    forced: np.ndarray

    def inner(self, repeated: np.ndarray) -> np.ndarray:
        """The lines within which no chunk lies that isn't repeated; chunks cut by what stands before the line, or by the end of the page, don't tell."""
        other = np.r_[0, np.cumsum(~repeated & ~self.forced)]
        first, last = np.searchsorted(self.starts, self.start + WINDOW, side="left"), np.searchsorted(self.ends, self.end, side="right")
        return other[np.maximum(first, last)] == other[first]

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        """The lines that only repeated chunks meet."""
        other = np.r_[0, np.cumsum(~repeated)]
        first, last = np.searchsorted(self.ends, self.start, side="right"), np.searchsorted(self.starts, self.end, side="left")
        return other[last] == other[first]


class Lines:
    """Normalised lines of texts; those of short lines are kept (at most ``held``)."""

    def __init__(self, held: int = 200_000) -> None:
        self.known: dict[str, bytes] = {}
        self.held = held

    def of(self, text: str | None) -> tuple[list[int], list[bytes]]:
        """Numbers, from 1, and normalised bytes of the lines that aren't blank."""
        numbers, lines = [], []
        for k, raw in enumerate(text.split("\n") if text else (), 1):
            made = self.known.get(raw)
            if made is None:
                made = normalised(raw).encode("utf-8", "surrogatepass")
                if len(raw) < 120:
                    if len(self.known) >= self.held:
                        self.known.clear()
                    self.known[raw] = made
            if made:
                numbers.append(k)
                lines.append(made)
        return numbers, lines


def _in_parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about _AT_ONCE characters of text; a text isn't divided."""
    sizes = [len(x or "") for x in batch.column(column).to_pylist()]
    begun = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held > _AT_ONCE or i + 1 == len(sizes):
            yield batch.slice(begun, i + 1 - begun)
            begun, held = i + 1, 0


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, chunk, n): on how many pages of the task each chunk stands."""
    chunker, lines = Chunker(), Lines()
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        site, chunk, n = (np.concatenate([h[k] for h in held]) for k in range(3))
        order = np.lexsort((chunk, site))
        site, chunk, n = site[order], chunk[order], n[order]
        first = np.flatnonzero(np.r_[True, (site[1:] != site[:-1]) | (chunk[1:] != chunk[:-1])]) if len(site) else np.zeros(0, np.int64)
        return site[first], chunk[first], np.add.reduceat(n, first) if len(first) else n

    def flush() -> Iterator[pa.RecordBatch]:
        site, chunk, n = merged()
        for k in range(0, len(site), 100_000):
            yield pa.record_batch([pa.array(x[k : k + 100_000]) for x in (site, chunk, n)], names=["site", "chunk", "n"])

    for batch in batches:
        for part in _in_parts(batch, 1):
            pages = [lines.of(t)[1] for t in part.column(1).to_pylist()]
            if not any(pages):
                continue
            cuts = chunker.cut(pages)
            page = np.repeat(np.arange(len(pages)), cuts.per_page)
            order = np.lexsort((cuts.chunk, page))
            page, chunk = page[order], cuts.chunk[order]
            once = np.r_[True, (page[1:] != page[:-1]) | (chunk[1:] != chunk[:-1])]
            page, chunk = page[once], chunk[once]
            held.append((part.column(0).to_numpy()[page], chunk, np.ones(len(chunk), np.int64)))
            size += len(chunk)
            if size > 1 << 20:
                held = [merged()]
                size = len(held[0][0])
                if size > 1 << 19:
                    yield from flush()
                    held, size = [], 0
    if held:
        yield from flush()


def _lines_of(covered: bool):
    """(doc_id, site, line_no, line) of the candidates, or of the lines made of repeated chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker, lines = Chunker(), Lines()
        sets: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in _in_parts(batch, 1):
                read = [lines.of(t) for t in part.column(1).to_pylist()]
                if not any(numbers for numbers, _ in read):
                    continue
                cuts = chunker.cut([x for _, x in read])
                sites = part.column(2).to_numpy()
                repeated = np.zeros(len(cuts.chunk), bool)
                at = np.r_[0, np.cumsum(cuts.per_page)]
                for i, site in enumerate(sites):
                    common = sets.get(site)
                    if common is None:
                        if len(sets) > 2000:
                            sets.clear()
                        found = part.column(3)[i].values
                        common = sets[site] = np.zeros(0, np.int64) if found is None else np.sort(found.to_numpy())
                    if not len(common):
                        continue
                    own = cuts.chunk[at[i] : at[i + 1]]
                    place = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    repeated[at[i] : at[i + 1]] = common[place] == own
                kept = cuts.covered(repeated) if covered else cuts.inner(repeated)
                page = np.repeat(np.arange(len(read)), cuts.count)[kept]
                numbers = np.fromiter((k for x, _ in read for k in x), np.int32, len(kept))[kept]
                yield pa.record_batch([part.column(0).take(pa.array(page)), pa.array(sites[page]), pa.array(numbers), pa.array(cuts.line[kept])], names=["doc_id", "site", "line_no", "line"])

    return run


def _near(kept: DataFrame, least: int, share_of: int, covered: bool) -> tuple[DataFrame, DataFrame]:
    """Lines by the chunks that their sites repeat, and ``(site, pages)``."""
    own = kept.where("site IS NOT NULL")
    pages_of = cut_lineage(own.groupBy("site").agg(F.count("*").alias("pages")))
    counted = own.select("site", "text").mapInArrow(_chunks, "site bigint, chunk bigint, n bigint").groupBy("site", "chunk").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # a site repeats at most share_of times the chunks that its pages have on average
    common = counted.join(pages_of, "site").where(F.col("n") * share_of >= F.col("pages")).groupBy("site").agg(F.first("pages").alias("pages"), F.collect_list("chunk").alias("common"))
    near = join_by_weight(own.select("doc_id", "text", "site"), cut_lineage(common), ["site"], "pages", how="left")
    rows = near.select("doc_id", "text", "site", "common").mapInArrow(_lines_of(covered), "doc_id string, site bigint, line_no int, line bigint")
    return rows, pages_of


def repeated_lines_of(kept: DataFrame, least: int = LEAST_PAGES, share_of: int = SHARE_OF) -> DataFrame:
    """The same as repeated_lines, from ``(doc_id, text, host, site)``."""
    near, pages_of = _near(kept, least, share_of, covered=False)
    near = cut_lineage(near)
    # a page counts once for a line it repeats within itself
    once = near.select("site", "line", "doc_id").distinct().groupBy("site", "line").agg(F.count("*").alias("n"))
    repeated = once.where(F.col("n") >= least).join(pages_of, "site").where(F.col("n") * share_of >= F.col("pages")).select("site", "line", "n")
    return join_by_weight(near, cut_lineage(repeated), ["site", "line"], "n").select("doc_id", "line_no")


def repeated_lines(pages: DataFrame, url_mapping: DataFrame, least: int = LEAST_PAGES, share_of: int = SHARE_OF) -> DataFrame:
    """``(doc_id, line_no)``: lines that stand on at least ``least`` pages of their site and on 1/share_of of its pages.

    line_no counts from 1 over the pieces between line feeds. All pages of a site count, NULL and blank ones too; a
    page that repeats a line within itself counts once for it, and all its places are returned. Pages without a host
    belong to no site.
    """
    return repeated_lines_of(kept_pages(pages, url_mapping), least, share_of)


def repeated_passages(pages: DataFrame, url_mapping: DataFrame, least: int = LEAST_PAGES, share_of: int = SHARE_OF) -> DataFrame:
    """``(doc_id, line_no)``: lines that consist of chunks repeated in the same sense, however the passage is wrapped.

    A passage shorter than a chunk or two may be missed at its ends; repeated_lines is exact for whole lines.
    """
    return _near(kept_pages(pages, url_mapping), least, share_of, covered=True)[0].select("doc_id", "line_no")


def without_repeated_lines(pages: DataFrame, url_mapping: DataFrame) -> DataFrame:
    """``(doc_id, text)``: every page once, without the lines its site repeats; the other lines stay as they are."""
    kept = kept_pages(pages, url_mapping)
    cut = repeated_lines_of(kept).groupBy("doc_id").agg(F.collect_list("line_no").alias("_cut"))
    pieces = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("t"), (i + 1).cast("int").alias("k")))
    left = F.transform(F.filter(pieces, lambda p: ~F.array_contains(F.col("_cut"), p["k"])), lambda p: p["t"])
    return kept.select("doc_id", "text").join(cut, "doc_id", "left").select("doc_id", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"))
