"""The best hits of many queries over packed documents, a block of documents at a time.

The hits of all queries number queries times documents, so they never become rows: a task holds the postings of a block
by term, adds them up for one query after the other and passes on only what may be among the best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 14  # documents of a block
NEAR = 4e-9  # scores closer than this may be equal once rounded to nine digits
COLUMNS = "form int, n_terms int, doc_id string, url string, score double, tf_idf double, matched int, page_rank double"
_NAMES = ["form", "n_terms", "doc_id", "url", "score", "tf_idf", "matched", "page_rank"]

# (number, different terms, [(number of the term, weight, first position)] in order of the terms)
Form = tuple[int, int, list[tuple[int, float, int]]]


class _Block:
    """Documents in order of their URL with the postings of each term."""

    def __init__(self, rows: pa.Table, log_tf: bool, average: float, link_weight: float):
        self.rows = rows.combine_chunks()
        self.size = n = rows.num_rows
        packed = pa.concat_arrays(self.rows["terms"].chunks)
        flat = packed.flatten()
        term, tf = flat.field(0).to_numpy(), flat.field(1).to_numpy().astype(float)
        doc = np.repeat(np.arange(n), packed.value_lengths().to_numpy())
        order = np.argsort(term, kind="stable")
        self.known, starts = np.unique(term[order], return_index=True)
        self.bounds = np.append(starts, len(order))
        self.doc, self.tf = doc[order], (1 + np.log10(tf) if log_tf else tf)[order]
        self.norm = np.ones(n) if log_tf else 0.1 + 0.9 * (self.rows["dl"].to_numpy() / average)
        self.link = link_weight * self.rows["page_rank"].to_numpy()
        self.depth = self.rows["depth"].to_numpy()
        self.rank = np.empty(n, np.int64)  # the order of the ids
        self.rank[pc.sort_indices(self.rows["doc_id"]).to_numpy()] = np.arange(n)
        key = self.rows["url_key"].chunk(0).dictionary_encode().indices.to_numpy()
        sizes = np.bincount(key)
        self.shared = np.flatnonzero(sizes[key] > 1)  # documents whose URL another one of the block has
        self.shared = self.shared[np.lexsort((self.rank[self.shared], key[self.shared]))]
        self.groups = np.flatnonzero(np.diff(key[self.shared], prepend=-1))
        self.sums, self.found, self.first = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def hits(self, form: Form, idf: np.ndarray, once: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents with a term, and their tf_idf, number of terms and score; with ``once`` the first document of a URL only."""
        _, n_terms, terms = form
        met = []
        for number, weight, first in terms:
            at = np.searchsorted(self.known, number)
            if at < len(self.known) and self.known[at] == number:
                part = slice(self.bounds[at], self.bounds[at + 1])
                docs = self.doc[part]
                met.append((first, docs))
                self.sums[docs] += idf[number] * weight * self.tf[part]
                self.found[docs] += 1
        which = np.flatnonzero(self.found)
        if once and len(self.shared) and len(which):
            self._drop_copies(met)
            which = which[self.found[which] > 0]
        matched = self.found[which]
        tf_idf = self.sums[which] / self.norm[which]
        score = (tf_idf + self.link[which]) * ((matched / n_terms) ** 4) * self.depth[which]
        for _, docs in met:
            self.sums[docs] = 0
            self.found[docs] = 0
        return which, tf_idf, matched, score

    def firsts(self, form: Form) -> np.ndarray:
        """The position of the first term of each document; only for documents that have one."""
        for number, _, first in sorted(form[2], key=lambda t: -t[2]):
            at = np.searchsorted(self.known, number)
            if at < len(self.known) and self.known[at] == number:
                self.first[self.doc[self.bounds[at] : self.bounds[at + 1]]] = first
        return self.first

    def _drop_copies(self, met: list[tuple[int, np.ndarray]]) -> None:
        for first, docs in sorted(met, key=lambda m: -m[0]):
            self.first[docs] = first
        there = self.found[self.shared] > 0
        n = len(self.shared)
        # documents are in order of id within their URL
        place = np.where(there, self.first[self.shared] * n, np.iinfo(np.int64).max // 2) + np.arange(n)
        least = np.repeat(np.minimum.reduceat(place, self.groups), np.diff(self.groups, append=n))
        self.found[self.shared[place > least]] = 0


def best_hits(forms: list[Form], idf: np.ndarray, average: float, link_weight: float, log_tf: bool, by_tf_idf: bool, top_n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches of (url_key, doc_id, url, dl, depth, page_rank, terms), all rows of a URL together in order of doc_id.

    It gives every hit that may be among the ``top_n`` best of a form by rounded score or tf_idf, then doc_id; of
    documents with equal scores, the least ids. A URL may have more documents than fit into a block.
    """

    def candidates(block: _Block, form: Form, best: np.ndarray) -> tuple | None:
        which, tf_idf, matched, score = block.hits(form, idf)
        value = tf_idf if by_tf_idf else score
        keep = score > 0
        if best[0] > -np.inf:
            keep &= value >= best[0] - NEAR
        keep = np.flatnonzero(keep)
        if not len(keep):
            return None
        if len(keep) > top_n:
            low = np.partition(value[keep], len(keep) - top_n)[len(keep) - top_n] - NEAR
            keep = keep[value[keep] >= low]
        if len(keep) > top_n:  # of equal values, the least ids will do
            keep = keep[np.lexsort((block.rank[which[keep]], -value[keep]))]
            begins = np.flatnonzero(np.append(True, np.diff(value[keep]) != 0))
            keep = keep[np.arange(len(keep)) - np.repeat(begins, np.diff(begins, append=len(keep))) < top_n]
        both = np.concatenate([best, value[keep]])
        best[:] = np.partition(both, len(both) - top_n)[len(both) - top_n :]
        best[[0, np.argmin(best)]] = best[[np.argmin(best), 0]]
        return which[keep], tf_idf[keep], matched[keep], score[keep]

    def made(rows: pa.Table, number, n_terms, at, tf_idf, matched, score) -> pa.RecordBatch:
        taken = rows.select(["doc_id", "url", "page_rank"]).take(pa.array(at)).combine_chunks()
        columns = [pa.array(number, pa.int32()), pa.array(n_terms, pa.int32()), taken["doc_id"], taken["url"], pa.array(score), pa.array(tf_idf), pa.array(matched, pa.int32()), taken["page_rank"]]
        return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(forms), top_n), -np.inf)
        carried: dict[int, tuple] = {}  # by form, the first document so far of a URL that goes on in the next block

        def of_block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            block = _Block(rows, log_tf, average, link_weight)
            parts, held = [], 0
            for k, form in enumerate(forms):
                got = candidates(block, form, best[k])
                if got is not None:
                    parts.append((np.full(len(got[0]), form[0]), np.full(len(got[0]), form[1]), *got))
                    held += len(got[0])
                if parts and (held > 1 << 16 or k == len(forms) - 1):
                    yield made(block.rows, *map(np.concatenate, zip(*parts, strict=True)))
                    parts, held = [], 0
            if parts:
                yield made(block.rows, *map(np.concatenate, zip(*parts, strict=True)))

        def carry(rows: pa.Table) -> None:
            block = _Block(rows, log_tf, average, link_weight)
            for k, form in enumerate(forms):
                which, tf_idf, matched, score = block.hits(form, idf)
                if len(which):  # one, as they share the URL
                    first = int(block.firsts(form)[which[0]])
                    if k not in carried or first < carried[k][0]:
                        row = block.rows.slice(int(which[0]), 1)
                        carried[k] = (first, row["doc_id"][0].as_py(), row["url"][0].as_py(), score[0], tf_idf[0], matched[0], row["page_rank"][0].as_py())

        def let_go() -> Iterator[pa.RecordBatch]:
            rows = [(forms[k][0], forms[k][1], *c[1:]) for k, c in carried.items() if c[3] > 0]
            carried.clear()
            if rows:
                kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)], names=_NAMES)

        open_key = None  # the URL of what is carried
        for rows, ahead in _blocks(batches):
            keys = rows["url_key"]
            if open_key is not None:
                n = rows.num_rows if keys[-1].as_py() == open_key else int(pc.index(pc.equal(keys, open_key), False).as_py())
                if n:
                    carry(rows.slice(0, n))
                    rows = rows.slice(n)
                if rows.num_rows or ahead != open_key:
                    yield from let_go()
                    open_key = None
            if rows.num_rows and ahead is not None and rows["url_key"][-1].as_py() == ahead:
                n = int(pc.index(rows["url_key"], ahead).as_py())
                carry(rows.slice(n))
                rows, open_key = rows.slice(0, n), ahead
            if rows.num_rows:
                yield from of_block(rows)
        yield from let_go()

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, str | None]]:
    """Blocks of rows, each with the URL that the next begins with."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            if size and size + part.num_rows > BLOCK:
                yield pa.Table.from_batches(held), part.column(0)[0].as_py()
                held, size = [], 0
            held.append(part)
            size += part.num_rows
    if size:
        yield pa.Table.from_batches(held), None
