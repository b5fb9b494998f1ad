"""Byte-level BPE with the merge ranks of a public vocabulary.

Merging takes the lowest rank first, leftmost first. The pairs that can still be merged wait in one bucket per rank; a
bitmap of three levels marks the ranks whose bucket holds something, so the next rank is found by three find-first-set
steps. Positions form a linked list. A merge doesn't look for the entries it makes invalid: they are skipped when their
bucket is taken. A pre-token of n bytes thus costs about n steps (besides sorting buckets), however long it is.

Results are kept per pre-token and per blank-delimited piece, so every distinct piece of a task is merged once.
"""

from __future__ import annotations

import base64
from itertools import chain

import regex

# Fixed value: the pre-token pattern of the byte_bpe vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_BITS = 6


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a file whose lines hold a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


class RankQueue:
    """Buckets of positions by rank, the least non-empty rank first."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.middle: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word, block = rank >> _BITS, rank >> 2 * _BITS
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.middle[block] = self.middle.get(block, 0) | 1 << (word & 63)
        self.top |= 1 << block

    def pop(self) -> tuple[int, list[int]] | None:
        """The least rank and its positions from left to right."""
        if not self.top:
            return None
        block = (self.top & -self.top).bit_length() - 1
        bits = self.middle[block]
        word = (block << _BITS) + (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = (word << _BITS) + (bits & -bits).bit_length() - 1
        self.low[word] = bits & bits - 1
        if not self.low[word]:
            self.middle[block] &= ~(1 << (word & 63))
            if not self.middle[block]:
                self.top &= ~(1 << block)
        return rank, sorted(self.buckets.pop(rank))


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    whole = ranks.get(data)
    if whole is not None:
        return [whole]
    n = len(data)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\1") * n
    queue = RankQueue()
    for i in range(n - 1):
        rank = ranks.get(data[i : i + 2])
        if rank is not None:
            queue.push(rank, i)
    while (taken := queue.pop()) is not None:
        rank, positions = taken
        for i in positions:
            j = after[i]
            if not alive[i] or j >= n or ranks.get(data[i : end[j]]) != rank:
                continue  # stale
            alive[j] = 0
            end[i] = end[j]
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                right = ranks.get(data[i : end[after[j]]])
                if right is not None:
                    queue.push(right, i)
            if before[i] >= 0:
                left = ranks.get(data[before[i] : end[i]])
                if left is not None:
                    queue.push(left, before[i])
    return [ranks[data[i : end[i]]] for i in range(n) if alive[i]]


class _Memo(dict):
    """A dict that computes what it lacks."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self[key] = self.compute(key)
        return value


class Encoder:
    """Ids of whole texts; special tokens' strings are ordinary text. ``held`` bounds the pieces kept."""

    def __init__(self, ranks: dict[bytes, int], held: int = 300_000) -> None:
        self.ranks = ranks
        self.held = held
        split = regex.compile(PATTERN).findall
        self.tokens = _Memo(lambda t: tuple(merge(t.encode(), ranks)))
        token = self.tokens.__getitem__
        self._first = _Memo(lambda piece: tuple(chain.from_iterable(map(token, split(piece)))))
        self._later = _Memo(lambda piece: tuple(chain.from_iterable(map(token, split(" " + piece)))))
        self._split = split
        # A piece may be cut off before a single blank that is followed by something else than white space, as every
        # pre-token ends there; texts with blanks beside other white space are cut by the pattern.
        self._mixed = regex.compile(r" (?=\s|$)").search

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if len(self.tokens) + len(self._first) + len(self._later) > self.held:
            for memo in (self.tokens, self._first, self._later):
                memo.clear()
        if self._mixed(text):
            return list(chain.from_iterable(map(self.tokens.__getitem__, self._split(text))))
        first, *later = text.split(" ")
        ids = list(self._first[first]) if first else []
        ids.extend(chain.from_iterable(map(self._later.__getitem__, later)))
        return ids
