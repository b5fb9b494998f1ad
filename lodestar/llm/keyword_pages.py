"""Pages made of repeated keywords, bare lists of links, products or tags, or sentences built around one phrase.

Two kinds of evidence meet. List density tells what share of a page's own words (those of lines that don't recur on its
host) stands in entries: bare entries (addresses, tags, products, keywords without any function word), strung entries
(many short pieces on one line, as lists of titles are), and words of stuffed lines, which repeat one phrase.
Replication tells how much of the page is stitched from phrases that stand elsewhere too: the shingles of five words of
all lines of all pages are exploded and the different hosts of each are counted. Bare lists share hardly a phrase with
anything, so density alone decides on them; strung entries and stuffed lines count as far as their phrases are
replicated, since a list of names or a refrain of the page's own isn't spam.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import normalise_url
from lodestar.llm.lines import FUNCTION_WORDS, LINK, Letters, Line, code_of
from lodestar.llm.pages import kept_pages, sites
from lodestar.llm.residue import has_message, is_residue, lines_of, recurrent
from lodestar.operators.heavy_keys import key_counts
from lodestar.session import cut_lineage, join_by_weight, written

PRODUCT = re.compile(r"[$€£]\s?\d|\d\s?[$€£]|add to cart|in stock|\bSKU\b|★|buy now|in den warenkorb|añadir al carrito|ajouter au panier", re.I)
TAG = re.compile(r"#[\w-]{3,}|\b[a-z]{3,}[-_][a-z]{3,}\b", re.I)
SHINGLE = 5
HOSTS = 3  # replication settles this number by the least, the greatest and one between
DENSE, LINKED = 0.55, 0.45  # share of own words in entries; with LINKS links, and a sixth of the words as many, the lesser will do
LINKS = 10
ENTRY_WORDS = 8  # fewer aren't a list
REPLICATED = 0.3  # share of a strung or stuffed page's shingles that other hosts have
PHRASE = 0.25  # share of a line's words in its commonest pair
BARE, STRUNG, STUFFED, PLAIN = 1, 2, 3, 0
BLOCK = 1 << 21  # shingles of a block of pages, about


def kind_of(x: Line, residue: bool | None = None) -> int:
    """Bare entries, strung entries, a line stuffed with one phrase, or plain text; ``residue`` tells whether the line is such, if that is known."""
    n = len(x.words)
    if n > 12 and x.function_share >= 0.1 and x.parts < 4:  # prose, unless it is built around a phrase
        return STUFFED if refrain(x.words) and not (is_residue(x) if residue is None else residue) else PLAIN
    if is_residue(x) if residue is None else residue:
        return PLAIN
    if n == 0:
        return BARE if LINK.search(x.text) else PLAIN
    if n <= 12 and has_message(x):
        return PLAIN
    if x.function_share < 0.04 and not (n < 4 and x.digits):
        return BARE
    if n <= 12 and x.function_share < 0.25 and (PRODUCT.search(x.text) or LINK.search(x.text)):
        return BARE
    if x.function_share < 0.1 and (len(TAG.findall(x.text)) * 4 >= n or len(LINK.findall(x.text)) * 6 >= n):
        return BARE
    if x.parts >= 4 and not x.closed and n <= 12 * x.parts:
        return STRUNG
    return STUFFED if refrain(x.words) else PLAIN


def refrain(words: list[str]) -> tuple[str, str] | None:
    """The pair of content words that takes PHRASE of a line's words or more, standing there three times or more."""
    n = len(words)
    if n < 8 or len(set(words)) > 0.75 * n:  # a pair that takes a quarter of the words repeats that many of them
        return None
    pairs = Counter(zip(words, words[1:], strict=False))
    most, pair = max(((m, p) for p, m in pairs.items() if m > 2 and FUNCTION_WORDS.isdisjoint(p)), default=(0, None))
    return pair if most * 2 >= PHRASE * n else None


SLOT = "\ufffc"


def slotted(words: list[str]) -> list[str]:
    """The words of a line, its refrain as one slot: what is said around another refrain is the same phrase."""
    pair = refrain(words)
    if pair is None:
        return words
    out, i = [], 0
    while i < len(words):
        if i + 1 < len(words) and words[i] == pair[0] and words[i + 1] == pair[1]:
            out.append(SLOT)
            i += 2
        else:
            out.append(words[i])
            i += 1
    return out


class _Numbers(dict):
    """Numbers of words by a hash, 0 for none; at most ``held`` are kept."""

    held = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.held:
            self.clear()
        made = self[word] = code_of(word) & (1 << 64) - 1 or 1
        return made


class Shingler:
    """Numbers of all shingles of texts, line by line; a word gets a number by a hash, the refrain of a line is a slot."""

    def __init__(self, size: int = SHINGLE) -> None:
        self.size = size
        self.letters = Letters()
        self.known = _Numbers()
        self.factors = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(size)]

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of all texts in order, and the index of the text of each; repeated ones stay."""
        flat: list[int] = []
        ends: list[int] = []
        number = self.known.__getitem__
        for text in texts:
            for line in self.letters.spaced(text.lower()).split("\n"):
                words = line.split()
                if len(words) >= self.size:
                    flat.extend(map(number, slotted(words)))
                    flat.append(0)
            ends.append(len(flat))
        h = np.array(flat, np.uint64)
        n = max(0, len(h) - self.size + 1)
        made = np.zeros(n, np.uint64)
        whole = np.ones(n, bool)
        with np.errstate(over="ignore"):
            for k, f in enumerate(self.factors):
                part = h[k : k + n]
                made += part * f
                whole &= part != 0
            made = (made ^ (made >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        at = np.flatnonzero(whole)
        return made[at].view(np.int64), np.searchsorted(np.array(ends), at, side="right")


_PACKED = "block bigint, doc_id string, total int, known int, open array<int>, shingle bigint, place int, low bigint, high bigint"
_PACKED_TYPES = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.int64(), pa.int64())


def _rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
    names = [c.split()[0] for c in _PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(names, _PACKED_TYPES, strict=True)], names=names)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values in order, where each first stands, and of all values which they are; np.unique sorts stably, which takes longer."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]][: len(values)]
    starts = np.flatnonzero(new)
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[starts], np.minimum.reduceat(order, starts) if len(values) else order, which


def _block(ids: list[str], site: np.ndarray, sited: np.ndarray, shingle: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of one block of pages; ``at`` has the page of each shingle, ``sited`` which pages have a site."""
    block = code_of(ids[0])
    made, first, which = _distinct(shingle)
    of_site, local = np.unique(site, return_inverse=True)
    with_site = sited[at]
    pairs = np.sort(which[with_site] * len(of_site) + local[at[with_site]])
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)]]  # np.unique hashes them first, which takes longer
    holder, held = pairs // len(of_site), of_site[pairs % len(of_site)]
    full = np.bincount(holder, minlength=len(made)) >= HOSTS
    # what isn't settled here is numbered as it comes, so that steps between the numbers are mostly 1
    unsettled = np.flatnonzero(~full)
    unsettled = unsettled[np.argsort(first[unsettled])]
    place = np.zeros(len(made), np.int32)
    place[unsettled] = np.arange(len(unsettled))
    left = ~full[which]
    number, page = place[which[left]], at[left]
    steps = np.diff(number, prepend=np.int32(0))
    starts = np.flatnonzero(np.r_[True, page[1:] != page[:-1]]) if len(page) else page
    steps[starts] = number[starts]
    n = len(ids)
    total, opened = np.bincount(at, minlength=n), np.bincount(page, minlength=n)
    yield _rows(
        n, block=pa.array(np.full(n, block)), doc_id=pa.array(ids, pa.string()), total=pa.array(total.astype(np.int32)),
        known=pa.array((total - opened).astype(np.int32)), open=_lists(steps, opened),
    )
    settled = np.flatnonzero(full)
    for k in range(0, len(settled), 100_000):
        part = settled[k : k + 100_000]
        yield _rows(len(part), shingle=pa.array(made[part]))
    # of at most two sites, the least and the greatest; pairs come in the order of shingles and sites
    others = np.flatnonzero(~full)
    low, high = np.searchsorted(holder, others, side="left"), np.searchsorted(holder, others, side="right")
    none = low == high
    held = np.r_[held, 0]
    low, high = held[np.where(none, len(held) - 1, low)], held[np.where(none, len(held) - 1, high - 1)]
    for k in range(0, len(others), 100_000):
        part, lack = others[k : k + 100_000], none[k : k + 100_000]
        yield _rows(
            len(part), block=pa.array(np.full(len(part), block)), shingle=pa.array(made[part]), place=pa.array(place[part]),
            low=pa.array(low[k : k + 100_000], mask=lack), high=pa.array(high[k : k + 100_000], mask=lack),
        )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of pages: a row per page and a row per different shingle of the block.

    A shingle that HOSTS sites of the block have is settled there and comes without a place; of the others each has its
    place in the block and its sites, two at most, and each page the places of its occurrences, as steps from one to the
    next.
    """
    shingler = Shingler()
    held: list[tuple] = []
    size = 0

    def closed() -> Iterator[pa.RecordBatch]:
        ids, site, sited, shingle, at = zip(*held, strict=True)
        before = np.cumsum([0, *map(len, ids)])
        yield from _block(sum(ids, []), np.concatenate(site), np.concatenate(sited), np.concatenate(shingle), np.concatenate([a + b for a, b in zip(at, before, strict=False)]))

    for batch in (part.slice(k, 1000) for part in batches for k in range(0, len(part), 1000)):
        shingle, at = shingler.of(batch.column(1).to_pylist())
        site = batch.column(2)
        held.append((batch.column(0).to_pylist(), site.fill_null(0).to_numpy(), site.is_valid().to_numpy(zero_copy_only=False), shingle, at))
        size += len(shingle)
        if size > BLOCK:
            yield from closed()
            held, size = [], 0
    if held:
        yield from closed()


def _shares(pages: pa.Table, shared: pa.Table) -> pa.Table:
    """``(doc_id, replicated)`` of one block, from its pages and the places of its shingles that proved to be shared."""
    places = shared.column("place").to_numpy()
    opened = pages.column("open").combine_chunks()
    sizes = opened.value_lengths().to_numpy(zero_copy_only=False)
    steps = opened.flatten().to_numpy()
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # numbers run on within a page and start anew with the next
    number = np.cumsum(steps, dtype=np.int64)
    offset = np.r_[0, number][starts]
    number -= np.repeat(offset, sizes)
    is_shared = np.zeros(max(number.max(initial=-1), places.max(initial=-1)) + 1, bool)
    is_shared[places] = True
    found = np.r_[0, np.cumsum(is_shared[number])]
    total = pages.column("total").to_numpy()
    share = (pages.column("known").to_numpy() + found[ends] - found[starts]) / np.maximum(total, 1)
    return pa.table({"doc_id": pages.column("doc_id"), "replicated": pa.array(share)})


def page_links(edges: DataFrame, url_mapping: DataFrame) -> DataFrame:
    """``(doc_id, links)``: how many rows of the link table start from the page; pages without any are missing."""
    out = key_counts(edges, {"src": normalise_url(F.col("src"))}).select(F.col("key").alias("_url"), F.col("n"))
    named = sites(url_mapping).select("doc_id", F.lower("url").alias("_url"))
    return named.join(out, "_url").select("doc_id", F.col("n").alias("links"))


def replication(kept: DataFrame) -> DataFrame:
    """``(doc_id, replicated)`` of every page with a text: the share of its shingles that stand on HOSTS hosts or more, 0 if it has none.

    Pages without a host count for none, but have their share. Texts are read once; pages stay packed by blocks, and the
    different shingles of each block, not those of its pages, meet their hosts.
    """
    rows = written(kept.where("text IS NOT NULL").select("doc_id", "text", "site").mapInArrow(_packed, _PACKED))
    # three sites differ if one lies between the least and the greatest
    all_of = Window.partitionBy("shingle")
    met = rows.where("shingle IS NOT NULL").select("block", "shingle", "place", "low", "high")
    met = met.withColumns({"_least": F.min("low").over(all_of), "_most": F.max("high").over(all_of)})
    between = ((F.col("low") > F.col("_least")) & (F.col("low") < F.col("_most"))) | ((F.col("high") > F.col("_least")) & (F.col("high") < F.col("_most")))
    met = met.withColumn("_shared", F.max(F.col("place").isNull() | F.coalesce(between, F.lit(False))).over(all_of))
    shared = met.where("_shared AND place IS NOT NULL").select("block", "place")
    pages = rows.where("doc_id IS NOT NULL").select("block", "doc_id", "total", "known", "open")
    return pages.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_shares, "doc_id string, replicated double")


def evidence_of(rows: DataFrame, kept: DataFrame, url_mapping: DataFrame, edges: DataFrame, sized: DataFrame | None = None) -> DataFrame:
    """The evidence from the rows of residue.lines_of, with entries, and ``(doc_id, text, host, site)``; see keyword_evidence.

    Which lines recur is worked out unless ``sized`` tells, which is residue.recurrent of the rows.
    """
    rows = rows.select("doc_id", "site", "code", F.col("entry").alias("kind"), F.col("size").alias("words"))
    line = F.inline(F.arrays_zip("code", "kind", "words"))
    if sized is None:
        sized = recurrent(rows, rows.where("site IS NOT NULL").select("site", F.explode("code").alias("code")).groupBy("site", "code").agg(F.count("*").alias("n")))
    # only pages with some entries can be found, whatever else is subtracted
    listing = F.aggregate(F.zip_with("kind", "words", lambda k, w: F.when(k > 0, w).otherwise(0)), F.lit(0), lambda a, b: a + b)
    some = rows.where(listing > 0).select("doc_id", "site", line)
    own = join_by_weight(cut_lineage(some), sized, ["site", "code"], "n", how="left").where("recurs IS NULL")
    part = lambda k: F.sum(F.when(F.col("kind") == k, F.col("words")).otherwise(0))
    pages = own.groupBy("doc_id").agg(F.sum("words").alias("words"), part(BARE).alias("bare"), part(STRUNG).alias("strung"), part(STUFFED).alias("stuffed"))
    pages = cut_lineage(pages)
    joined = pages.join(replication(kept), "doc_id", "left").join(page_links(edges, url_mapping), "doc_id", "left")
    return joined.withColumn("replicated", F.coalesce("replicated", F.lit(0.0))).withColumn("links", F.coalesce("links", F.lit(0).cast("bigint")))


def judged(evidence: DataFrame) -> DataFrame:
    """Evidence with ``keyword_page``."""
    entries = F.col("bare") + F.when(F.col("replicated") >= REPLICATED, F.col("strung") + F.col("stuffed")).otherwise(0)
    linked = (F.col("links") >= LINKS) & (F.col("links") * 6 >= F.col("words"))
    return evidence.withColumn("keyword_page", (entries >= ENTRY_WORDS) & ((entries >= DENSE * F.col("words")) | linked & (entries >= LINKED * F.col("words"))))


def keyword_evidence(pages: DataFrame, url_mapping: DataFrame, edges: DataFrame) -> DataFrame:
    """``(doc_id, words, bare, strung, stuffed, replicated, links, keyword_page)`` of pages with any such entries.

    ``words`` counts the words of lines that don't recur on the host, ``bare``, ``strung`` and ``stuffed`` those in such
    lines; ``replicated`` is the share of the page's shingles that stand on HOSTS hosts or more (0 if it has
    none), ``links`` the page's links in the link table. NULL and blank pages are missing; a page without a host has
    no recurrent lines.
    """
    kept = kept_pages(pages, url_mapping)
    return judged(evidence_of(lines_of(kept, residue=False, entry_of=kind_of), kept, url_mapping, edges))


def keyword_pages(pages: DataFrame, url_mapping: DataFrame, edges: DataFrame) -> DataFrame:
    """``(doc_id)`` of the pages that are keyword stuffing or bare lists, each once."""
    return keyword_evidence(pages, url_mapping, edges).where("keyword_page").select("doc_id")
