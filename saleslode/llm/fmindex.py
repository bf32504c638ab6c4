"""Substring dedup by words: a compressed FM-index per shard and matching statistics.

Shards hold the segments whose windows may be repeated (see ``repeats``); equal windows are
always in one shard. A shard's index is its Burrows-Wheeler transform over word numbers in a
wavelet matrix of packed bits with block counts. Its segments are streamed against it, all
at once, one backward step each: a pattern grows to the left as long as it stands twice in the
shard. A pattern that reaches a window's first word makes the window repeated, and the next
pattern ends further to the right; one that fails rules out every window it would have
been part of, so unlike texts are skipped in long strides. Suffixes are sorted by their
first ``DEPTH`` words only, which is exact for patterns up to that length.

Edge cases: NULL, empty and short texts lose nothing; repeated rows lose all their windows,
each; a text that repeats within itself too; NULL ids are kept; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import Words, id_and_text, table
from .repeats import Unit, removed

WINDOW, GRAM = 35, 8
DEPTH = 64
SHARD_BYTES = 2 << 20


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols, by doubling."""
    rank, size, width = text.astype(np.int64), len(text), 1
    order = np.argsort(rank, kind="stable")
    while width < depth:
        behind = np.zeros(size, np.int64)
        behind[:max(size - width, 0)] = rank[width:] + 1
        key = rank * (size + 2) + behind
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(size, np.int64)
        rank[order] = np.append(0, np.cumsum(key[1:] != key[:-1]))
        width *= 2
        if rank[order[-1]] == size - 1:
            break
    return order


class FmIndex:
    """Counts of symbols before a place of the transform, and ranges of patterns."""

    def __init__(self, text: np.ndarray, depth: int = DEPTH):
        order = suffix_order(text, depth)
        symbols = text[order - 1]
        self.size = len(text)
        top = int(text.max()) + 1
        self.before = np.append(0, np.cumsum(np.bincount(text, minlength=top)))
        self.levels = max(1, (top - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels):
            bit = (symbols >> (self.levels - 1 - level)) & 1
            padded = np.zeros((self.size // 64 + 1) * 64, np.uint8)
            padded[:self.size] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.counts.append(np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.zeros.append(self.size - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        every = np.arange(top)
        self.start = np.zeros(top, np.int64)
        self.start = self._descend(every, np.zeros(top, np.int64))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            block = place >> 6
            mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[level][block] + np.bitwise_count(self.words[level][block] & mask)
            bit = (symbol >> (self.levels - 1 - level)) & 1
            place = np.where(bit == 1, self.zeros[level] + ones, place - ones)
        return place

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Ranges of the patterns with a symbol put before them."""
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = np.concatenate([self.before[symbol] - self.start[symbol]] * 2)
        both = both + base
        return both[:len(symbol)], both[len(symbol):]


def repeated_windows(index: FmIndex, text: np.ndarray, base: np.ndarray, size: np.ndarray,
                     window: int, depth: int) -> np.ndarray:
    """Flags, by place in ``text``, of windows that stand twice; streams start at ``base``."""
    found = np.zeros(len(text) + 1, np.int64)  # +1 where a run of such windows starts, -1 after
    live = np.flatnonzero(size >= window)
    base, last = base[live], size[live] - window  # last window of each stream
    x = np.zeros(len(live), np.int64)
    ahead = np.zeros(len(live), np.int64)          # windows tried beyond x at once
    barred = np.full((2, len(live)), -1, np.int64)  # (first, end) of a string that stands once
    end = x + window - 1
    at = end.copy()
    low, high = np.zeros(len(live), np.int64), np.full(len(live), index.size)
    while len(x):
        low, high = index.extend(text[base + at], low, high)
        once = high - low < 2
        reached = ~once & (at == x)
        moved = once | reached
        if moved.any():
            yes = np.flatnonzero(reached)
            np.add.at(found, base[yes] + x[yes], 1)
            np.add.at(found, base[yes] + x[yes] + ahead[yes] + 1, -1)
            x[yes] += ahead[yes] + 1
            free = barred[1, yes] < 0
            ahead[yes] = np.where(free, np.minimum(2 * ahead[yes] + 1, depth - window), 0)
            no = np.flatnonzero(once & (ahead == 0))
            x[no] = at[no] + 1
            barred[:, no] = -1
            far = np.flatnonzero(once & (ahead > 0))
            barred[0, far], barred[1, far] = at[far], end[far]
            ahead[far] = 0
            skip = (barred[1] >= 0) & (x + window - 1 >= barred[1])
            x[skip] = np.maximum(x[skip], barred[0, skip] + 1)
            barred[:, skip] = -1
            ahead = np.minimum(ahead, np.maximum(last - x, 0))
            fresh = moved | skip
            end = np.where(fresh, x + ahead + window - 1, end)
            low, high = np.where(fresh, 0, low), np.where(fresh, index.size, high)
            at = np.where(fresh, end, at - 1)
            go = x <= last
            if not go.all():
                base, last, x, ahead, end, at, low, high = (
                    v[go] for v in (base, last, x, ahead, end, at, low, high))
                barred = barred[:, go]
        else:
            at = at - 1
    return np.cumsum(found)[:-1] > 0


def match_words(segments: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each segment with some: its windows that stand twice in the shard."""
    if not segments:
        return
    offsets = np.append(0, np.cumsum([len(s) for s in segments]))
    words = Words(np.concatenate(segments), offsets)
    _, ids = np.unique(words.hashes(), return_inverse=True)
    size = np.diff(words.first)
    base = words.first[:-1] + np.arange(len(segments))
    text = np.zeros(len(ids) + len(segments), np.int64)  # 0 closes each segment
    text[np.arange(len(ids)) + np.repeat(np.arange(len(segments)), size)] = ids + 1
    flags = repeated_windows(FmIndex(text), text, base, size, WINDOW, DEPTH)
    for i, (at, count) in enumerate(zip(base.tolist(), size.tolist(), strict=True)):
        windows = np.flatnonzero(flags[at:at + max(count - WINDOW + 1, 0)])
        if len(windows):
            yield i, windows


WORD_UNIT = Unit(words=True, window=WINDOW, gram=GRAM)


def without_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Every row with its words, removed words, spans and digest of the words that stay."""
    return removed(docs, WORD_UNIT, match_words, SHARD_BYTES, keep_text)


def op4_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(id_and_text(table(spark, sf_dir, "documents")))
    return found.select("doc_id", found["n_units"].alias("n_words"), "n_removed", "kept_sha256")
