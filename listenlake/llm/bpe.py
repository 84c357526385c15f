"""Byte-pair merges of many words at once, on flat numpy arrays.

All words lie one after another in one symbol array. In a round, the rank of each neighbouring pair is known, the least
rank of each word is found by a segmented minimum, every word merges its leftmost pair of that rank, and the array is
compacted; words without a pair leave it. That is the order in which a priority queue of (rank, place) merges, so results
are those of the sequential algorithm. A word of more than LONG symbols would need as many rounds; it goes through such a
queue instead.
"""

from __future__ import annotations

import heapq

import numpy as np

LONG = 400
NONE = np.iinfo(np.int32).max


class Merges:
    """left, right: symbols of each pair; rank: its order, least first; result: the symbol that a merge makes."""

    def __init__(self, left, right, rank, result, symbols: int):
        key = np.asarray(left, np.int64) * symbols + np.asarray(right, np.int64)
        order = np.argsort(key, kind="stable")
        self.symbols = symbols
        self.keys = np.append(key[order], np.iinfo(np.int64).max)
        self.rank = np.append(np.asarray(rank, np.int32)[order], NONE).astype(np.int32)
        self.result = np.append(np.asarray(result, np.int32)[order], -1).astype(np.int32)
        self.none = len(order)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of each pair, `none` where there is no such pair."""
        key = left.astype(np.int64) * self.symbols + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, self.none).astype(np.int32)

    def one_word(self, symbols: list[int]) -> list[int]:
        """Sequential merges of one long word by a priority queue."""
        sym, n = list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def push(pairs: list[tuple[int, int]]) -> None:
            if not pairs:
                return
            found = self.find(np.array([sym[i] for i, _ in pairs]), np.array([sym[j] for _, j in pairs]))
            for (i, j), k in zip(pairs, found.tolist()):
                if k != self.none:
                    heapq.heappush(heap, (int(self.rank[k]), i, sym[i], sym[j], k))

        push([(i, i + 1) for i in range(n - 1)])
        while heap:
            _, i, a, b, k = heapq.heappop(heap)
            j = after[i] if sym[i] >= 0 else n
            if j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], sym[j] = int(self.result[k]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push([(x, y) for x, y in ((before[i], i), (i, after[i])) if x >= 0 and y < n])
        return [s for s in sym if s >= 0]

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and lengths of the words after all merges, in the order given."""
        lengths = np.asarray(lengths, np.int64)
        total = len(lengths)
        out_length = np.zeros(total, np.int64)
        done_words: list[np.ndarray] = []
        done_symbols: list[np.ndarray] = []

        def finish(words: np.ndarray, size: np.ndarray, sym: np.ndarray) -> None:
            out_length[words] = size
            done_words.append(np.repeat(words, size))
            done_symbols.append(sym)

        sym = np.array(symbols, np.int32)
        long = lengths > LONG
        if long.any():
            ends = np.cumsum(lengths)
            for w in np.flatnonzero(long).tolist():
                made = self.one_word(sym[ends[w] - lengths[w] : ends[w]].tolist())
                finish(np.array([w]), np.array([len(made)]), np.array(made, np.int32))
            sym = sym[np.repeat(~long, lengths)]
        words = np.flatnonzero(~long & (lengths > 0))
        size = lengths[words]
        if len(words):
            pair = np.full(len(sym), self.none, np.int32)
            last = np.cumsum(size) - 1
            pair[:-1] = self.find(sym[:-1], sym[1:])
            pair[last] = self.none
        while len(words):
            rank = self.rank[pair]
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, start)
            active = least != NONE
            if not active.all():
                of_done = np.repeat(~active, size)
                finish(words[~active], size[~active], sym[of_done])
                keep = ~of_done
                sym, pair, rank = sym[keep], pair[keep], rank[keep]
                words, size, least = words[active], size[active], least[active]
                if not len(words):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            end = np.cumsum(size)
            owner = np.searchsorted(end, hit, side="right")
            leftmost = np.empty(len(hit), bool)
            leftmost[0] = True
            np.not_equal(owner[1:], owner[:-1], out=leftmost[1:])
            at = hit[leftmost]
            sym[at] = self.result[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            pair[at] = pair[at + 1]  # whether the merged symbol is now the last of its word shows below
            sym, pair = sym[keep], pair[keep]
            at = at - np.arange(len(at))
            size = size - 1
            end = np.cumsum(size)
            begin = end - size
            inner = at + 1 < end
            pair[at] = self.none
            pair[at[inner]] = self.find(sym[at[inner]], sym[at[inner] + 1])
            follows = at > begin
            pair[at[follows] - 1] = self.find(sym[at[follows] - 1], sym[at[follows]])
        if not done_words:
            return np.zeros(0, np.int32), out_length
        order = np.argsort(np.concatenate(done_words), kind="stable")
        return np.concatenate(done_symbols)[order], out_length
