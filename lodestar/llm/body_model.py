"""Which lines of a page are its main body: boosted trees over a tree read off the lines, decoded from the root down.

Pages are text, so a tree is read off their lines: a page has regions (parted by blank lines), a region has runs of
lines of one form, a run has lines. The trees see what a DOM node would show: density of the run and region, the words
of the line (as attribute tokens, with weights learned from the sample), its depth and its siblings. They never see how
often a line recurs, for that is where the labels come from: on sampled sites, lines that recur there far more than
elsewhere, or recur outside the span of the page's prose, are furniture; long prose that doesn't recur, what stands
between such prose, and the heading before it are body. Lines of which recurrence says nothing don't train.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from math import log

import numpy as np

from lodestar.llm.boosting import Boosted, train
from lodestar.llm.lines import Line, Reader, bulleted, language_of, site_name, without_name

TOKENS = 4000
TRAIN_ROWS = 100_000  # lines that the trees are fitted on, of those of the sample evenly
MIXED_PRICE = 0.25
RECURS = 3  # pages of the sample of a site
FAR_ABOVE, NOT_ABOVE = 3.0, 1.7  # share among the site's pages against the share among all pages

_SHAPE = re.compile(r"[\w\s’'\"“”]+")  # what is left is the punctuation that siblings of one list share
_SHAPELESS = {c: None for c in range(128) if _SHAPE.fullmatch(chr(c))}
SIBLINGS = 3  # lines of one form after the prose make a list of the body


def heading_like(x: Line) -> bool:
    return 1 <= len(x.words) <= 16 and not (x.closed and len(x.words) > 3) and len(x.text) <= 110


def form(x: Line) -> int:
    """The form of a line: sibling lines of one form make a run."""
    n = len(x.words)
    if n >= 25 or x.closed and n >= 8:
        return 0  # prose
    if x.parts >= 3:
        return 1
    return 2 if n > 3 else 3


def tokens_of(x: Line, name: str) -> list[str]:
    """Attribute tokens of a line: its words and signs, the pairs of neighbours, its first token as such; @ is the site's name."""
    t = [("@" if len(w) >= 5 and name.startswith(w) else w) for w in x.shown] if name else list(x.shown)
    if not t:
        return []
    return [*dict.fromkeys(t), *dict.fromkeys(map(" ".join, zip(t, t[1:], strict=False))), "^" + t[0], "$" + t[-1]]


@dataclass
class Batch:
    """Non-blank lines of several pages: features, and page, index in its page, region and run of each."""

    x: np.ndarray
    page: np.ndarray
    at: np.ndarray
    region: np.ndarray
    run: np.ndarray


class Features:
    """Rows of numbers for the non-blank lines of pages; ``weights`` are log-odds of tokens, learned from the sample.

    What a line shows by itself is worked out once for each short line; what it shows among its relatives is worked out
    for many pages at once.
    """

    OWN = 13

    def __init__(self, weights: dict[str, float], held: int = 200_000) -> None:
        self.weights = weights
        self.held = held
        self.ids: dict[str | tuple[str, str], int] = {}
        self.own: list[tuple] = []
        self.shapes: dict[str, int] = {}

    def _add(self, x: Line, name: str) -> int:
        n = len(x.words)
        odds = [] if n >= 25 else [self.weights[w] for w in tokens_of(x, name) if w in self.weights]
        begin = x.text[:150]
        shape = begin.translate(_SHAPELESS) if begin.isascii() else _SHAPE.sub("", begin)
        self.own.append(
            (
                n, len(x.text), x.function_share, x.sentences, x.closed, x.digits, x.parts,
                max(odds, default=0.0), min(odds, default=0.0), sum(odds), sum(odds) / len(odds) if odds else 0.0, n < 25 and heading_like(x), n < 25 and bulleted(x.text),
                self.shapes.setdefault(shape, len(self.shapes)), len(shape), form(x), x.prose,
            )
        )
        return len(self.own) - 1

    def of(self, pages: list[tuple[list[Line | None], str]]) -> Batch:
        """The lines of pages of (lines, name of the site)."""
        if len(self.own) > self.held:
            self.ids.clear(), self.own.clear(), self.shapes.clear()
        ids: list[int] = []
        page: list[int] = []
        at: list[int] = []
        for p, (lines, name) in enumerate(pages):
            begins = name[:5]
            for i, x in enumerate(lines):
                if x is None:
                    continue
                if len(x.words) >= 25:
                    k = self._add(x, "")
                else:
                    named = begins and begins in x.low
                    key = (x.text, name) if named else x.text
                    k = self.ids.get(key, -1)
                    if k < 0:
                        k = self.ids[key] = self._add(x, name if named else "")
                ids.append(k)
                page.append(p)
                at.append(i)
        n = len(ids)
        if not n:
            return Batch(np.zeros((0, 1)), *(np.zeros(0, np.int64) for _ in range(4)))
        known, which = np.unique(np.array(ids), return_inverse=True)
        own = np.array([self.own[k] for k in known], np.float64)[which]
        return self._among(own, np.array(page), np.array(at))

    def _among(self, own: np.ndarray, page: np.ndarray, at: np.ndarray) -> Batch:
        n = len(page)
        idx = np.arange(n)
        own, shape, shape_size, kind, prose = own[:, : self.OWN], own[:, 13], own[:, 14], own[:, 15], own[:, 16] > 0
        words, closed, total = own[:, 0], own[:, 4], own[:, 9]
        new_page = np.r_[True, page[1:] != page[:-1]]
        new_region = new_page | np.r_[True, at[1:] > at[:-1] + 1]
        new_run = new_region | np.r_[True, kind[1:] != kind[:-1]]
        region, run, number = np.cumsum(new_region) - 1, np.cumsum(new_run) - 1, np.cumsum(new_page) - 1
        p0, r0, u0 = np.flatnonzero(new_page), np.flatnonzero(new_region), np.flatnonzero(new_run)
        start = p0[number]
        size_of_page = np.diff(np.r_[p0, n])[number]
        j = idx - start
        some = (closed > 0) & (words >= 6) & (own[:, 2] > 0.12) & (total < 3)

        def ends(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return np.minimum.reduceat(np.where(flag, j, size_of_page), p0)[number], np.maximum.reduceat(np.where(flag, j, -1), p0)[number]

        def per(values: np.ndarray, starts: np.ndarray, of: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, starts)[of]

        first, final = ends(prose)
        near, far = ends(some)
        ones = np.ones(n)
        size, run_size = per(ones, r0, region), per(ones, u0, run)
        strong = np.maximum.accumulate(np.where(total > 2, idx, -1))
        strong = np.r_[-1, strong[:-1]]
        there = strong >= start
        _, same, alike = np.unique(number * (int(shape.max()) + 1) + shape, return_inverse=True, return_counts=True)

        def shifted(values: np.ndarray, by: int, missing: float) -> np.ndarray:
            moved = idx + by
            inside = (moved >= 0) & (moved < n)
            inside[inside] = number[moved[inside]] == number[inside]
            out = np.full(n, missing)
            out[inside] = values[moved[inside]]
            return out

        columns = (
            alike[same], shape_size, j, size_of_page - 1 - j, j - first, j - final, j - near, j - far, per(prose.astype(float), p0, number), per(some.astype(float), p0, number),
            size, per(words, r0, region) / size, per(total, r0, region) / size, per(closed, r0, region) / size, run_size, per(total, u0, run) / run_size,
            total[r0][region], idx - r0[region], np.where(there, idx - strong, 99), np.where(there, total[strong], 0.0),
            shifted(words, -1, 0.0), shifted(total, -1, 0.0), shifted(closed, -1, -1.0), shifted(words, 1, 0.0), shifted(total, 1, 0.0), shifted(closed, 1, -1.0),
            shifted(total, -2, 0.0), shifted(total, 2, 0.0), new_region & ~new_page, shifted(new_region.astype(float), 1, 0.0),
        )
        return Batch(np.column_stack([own, *columns]), page, at, region, run)


def decode(margin: np.ndarray, region: list[int], run: list[int], price: float = MIXED_PRICE) -> np.ndarray:
    """Furniture (True) or body per line of one page, from log-odds of furniture, with consistent ancestors.

    Bottom-up each node weighs three choices: all its lines furniture, all body, or each child as is best for it, which
    costs ``price`` if the children differ. Top-down the best choice of an ancestor is imposed on what lies under it.
    """
    if not len(margin):
        return np.zeros(0, bool)
    furniture, body = np.minimum(margin, 0.0), np.minimum(-margin, 0.0)
    out = margin > 0
    runs, regions = np.asarray(run), np.asarray(region)
    starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
    of_region = regions[starts]
    all_f, all_b = np.add.reduceat(furniture, starts), np.add.reduceat(body, starts)
    lines = np.add.reduceat(out.astype(np.int64), starts)
    size = np.diff(np.r_[starts, len(margin)])
    free = np.where((lines == 0) | (lines == size), 0.0, -price)  # log-likelihood lost by leaving lines as they are is 0
    choice = np.argmax(np.stack([free, all_f, all_b]), 0)
    best = np.maximum(np.maximum(free, all_f), all_b)
    tops = np.flatnonzero(np.r_[True, of_region[1:] != of_region[:-1]])
    region_f, region_b, region_free = (np.add.reduceat(v, tops) for v in (all_f, all_b, best))
    part = np.where(choice == 0, lines / size, (choice == 1).astype(float))
    uniform = np.minimum.reduceat(part, tops) == np.maximum.reduceat(part, tops)
    region_free = np.where(uniform, region_free, region_free - price)
    pick = np.argmax(np.stack([region_free, region_f, region_b]), 0)
    decided = np.where(np.repeat(pick, np.diff(np.r_[tops, len(starts)])) == 0, choice, np.repeat(pick, np.diff(np.r_[tops, len(starts)])))
    per_line = np.repeat(decided, size)
    return np.where(per_line == 0, out, per_line == 1)


def furniture_lines(pages: list[tuple[list[Line | None], str]], made: Features, model: Boosted) -> list[list[int]]:
    """Per page of (lines, name of the site) the indexes of the non-blank lines outside the main body; all pages are scored at once."""
    batch = made.of(pages)
    out: list[list[int]] = [[] for _ in pages]
    found = decode(model.margin(batch.x), batch.region, batch.run)
    for p, i in zip(batch.page[found].tolist(), batch.at[found].tolist(), strict=True):
        out[p].append(i)
    return out


def weak_labels(pages: list[tuple[list[Line | None], str, str]]) -> list[dict[int, int]]:
    """Per page of (lines, name, site): furniture (1) or body (0) by the index of the line, as far as recurrence tells.

    Shares are taken among the pages of one language, on the site and altogether.
    """
    coded = [[None if x is None else without_name(x.low, name) for x in lines] for lines, name, _ in pages]
    groups = [(site, language_of(lines)) for lines, _, site in pages]
    size, every = Counter(groups), Counter(k for _, k in groups)
    near: dict[tuple, Counter] = defaultdict(Counter)
    overall: dict[int, Counter] = defaultdict(Counter)
    for codes, group in zip(coded, groups, strict=True):
        own = {c for c in codes if c is not None}
        near[group].update(own)
        overall[group[1]].update(own)
    out = []
    for codes, (lines, _, _), group in zip(coded, pages, groups, strict=True):
        count, all_of = near[group], overall[group[1]]
        recurs = [c is not None and count[c] >= RECURS for c in codes]
        above = [0.0 if c is None else (count[c] / size[group]) / (all_of[c] / every[group[1]]) for c in codes]
        long = [i for i, x in enumerate(lines) if x is not None and x.prose and not recurs[i]]
        label: dict[int, int] = {}
        first, final = (long[0], long[-1]) if long else (len(lines), -1)
        title = next((i for i in range(min(first, len(lines)) - 1, -1, -1) if lines[i] is not None and not recurs[i]), -1) if long else -1
        seen = inside = False
        siblings: list[int] = []  # lines after the prose and before anything recurs
        for i, x in enumerate(lines):
            if x is None:
                inside = False
                continue
            if first < i < final:
                if recurs[i] and above[i] >= FAR_ABOVE:
                    label[i] = 1
                elif not recurs[i] or above[i] < NOT_ABOVE:
                    label[i] = 0
                continue
            if i in (first, final):
                label[i] = 0
            elif recurs[i]:
                label[i] = 1
                seen = seen or i > final >= 0
                inside = True
            elif i == title:
                if heading_like(x):
                    label[i] = 0
            elif long and (i > final and seen and not x.prose or i < first and inside):
                label[i] = 1
            elif long and i > final:
                siblings.append(i)
        for k in {form(lines[i]) for i in siblings}:
            same = [i for i in siblings if form(lines[i]) == k]
            if len(same) >= SIBLINGS:
                label.update(dict.fromkeys(same, 0))
        out.append(label)
    return out


def thinned(lines: list[Line | None], label: dict[int, int], reader: Reader, lists: bool) -> tuple[list[Line | None], dict[int, int]] | None:
    """The page with less of a body, so that short bodies are learned too; None without long prose.

    One sentence of the first long prose stays; with ``lists`` the other lines of the body that aren't long prose stay as well.
    """
    body = [i for i, v in label.items() if v == 0 and lines[i] is not None and lines[i].prose]
    if not body:
        return None
    first = body[0]
    at = lines[first].text
    cut = min((k for k in (at.find(". "), at.find("! "), at.find("? ")) if k > 0), default=len(at) - 1)
    made, kept = [], {}
    for i, x in enumerate(lines):
        if i == first:
            x = reader.line(at[: cut + 1])
        elif i > first and (label.get(i) == 0 if not lists or x is not None and x.prose else False) or not lists and body[-1] > i > first and i not in label:
            continue
        if i in label:
            kept[len(made)] = label[i]
        made.append(x)
    return made, kept


def token_weights(pages: list[tuple[list[Line | None], str, dict[int, int]]], most: int = TOKENS) -> dict[str, float]:
    """Log-odds of furniture for the tokens of short lines, each page counting once for a token."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for lines, name, label in pages:
        own: tuple[set, set] = (set(), set())
        for i, v in label.items():
            if len(lines[i].words) < 25:
                own[v].update(tokens_of(lines[i], name))
        for v in (0, 1):
            seen[v].update(own[v])
    total = seen[0] + seen[1]
    ranked = sorted((e for e in total.items() if e[1] >= 5), key=lambda e: (-e[1], e[0]))[:most]
    return {w: log((seen[1][w] + 1) / (seen[0][w] + 1)) for w, _ in ranked}


def fit(sample: list[tuple[str, str | None]]) -> tuple[Boosted, dict[str, float]]:
    """A model from (text, host) of whole sampled sites. Weights of tokens come from the other half of the sites than the rows they stand in."""
    reader = Reader()
    pages = [(reader.page(t), site_name(h), h) for t, h in sample if t and h]
    labelled = [(lines, name, site, label) for (lines, name, site), label in zip(pages, weak_labels(pages), strict=True)]
    half = {s: k % 2 for k, s in enumerate(sorted({p[2] for p in labelled}))}
    x: list[np.ndarray] = []
    y: list[int] = []
    for k in (0, 1):
        others = [(lines, name, label) for lines, name, site, label in labelled if half[site] != k]
        made = Features(token_weights(others))
        versions = [
            (version, name) for lines, name, site, label in labelled if half[site] == k
            for version in ((lines, label), thinned(lines, label, reader, False), thinned(lines, label, reader, True)) if version is not None
        ]
        batch = made.of([(lines, name) for (lines, _), name in versions])
        known = [versions[p][0][1].get(i, -1) for p, i in zip(batch.page.tolist(), batch.at.tolist(), strict=True)]
        x.append(batch.x[np.array(known, np.int64) >= 0])
        y.extend(v for v in known if v >= 0)
    data = np.concatenate([part for part in x if len(part)]) if y else np.zeros((0, 1))
    step = 1 + len(y) // TRAIN_ROWS
    return train(data[::step], np.asarray(y, np.float64)[::step]), token_weights([(lines, name, label) for lines, name, _, label in labelled])
