"""Substring dedup by bytes: Burrows-Wheeler transforms of shards, merged by interleaving.

A window of 400 bytes is ``DEPTH`` symbols of ``STRIDE`` bytes: the symbol at a byte is the hash
of the bytes from there on, its successor the symbol ``STRIDE`` further. The segments of a
task (see ``repeats``; equal windows are always in one task) are dealt into parts, and each
part's suffixes are sorted by so many symbols, once. Parts are then merged without sorting
suffixes again: an interleave of the two transforms starts as one part after the other, and
each round moves every suffix to the place of its extension by the symbol before it, which
makes the interleave right for one more symbol. The round in which two neighbours first
differ is their common prefix; neighbours that never do share a window. Intervals of such
neighbours are the repeated strings. Before the sort, windows with a symbol that stands
nowhere else in the shard are left out: they cannot be repeated, and are most of the bytes.

Edge cases: NULL, empty and short texts lose nothing; repeated rows lose all of theirs if
long enough; a text that repeats within itself does too; NULL ids are kept; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import _BYTE_VALUE, id_and_text, prefix_sums, run_hashes, table
from .repeats import Unit, removed

WINDOW, GRAM, STRIDE = 400, 32, 100
DEPTH = WINDOW // STRIDE
SHARD_BYTES = 1 << 19
PARTS = 2


@dataclass
class Transform:
    """A sorted collection: places of the suffixes in order, symbol before each, prefixes.

    ``before`` is -1 where nothing stands before; ``common`` is the number of symbols, up to
    ``DEPTH``, that a suffix shares with the one before it in the order.
    """

    places: np.ndarray
    before: np.ndarray
    common: np.ndarray


def stable_order(values: np.ndarray) -> np.ndarray:
    """Stable argsort of small non-negative numbers: place and value are sorted as one."""
    shift = max(1, len(values)).bit_length()
    packed = (values << shift) | np.arange(len(values))
    packed.sort()
    return packed & ((1 << shift) - 1)


def symbols_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of the symbol at each byte, by order of hash; 0 where the text ends too soon."""
    lengths = np.diff(offsets)
    room = np.repeat(offsets[1:], lengths) - np.arange(len(data))
    starts = np.flatnonzero(room >= STRIDE)
    hashes = run_hashes(prefix_sums(_BYTE_VALUE[data]), starts, starts + STRIDE)
    symbols = np.zeros(len(data), np.int64)
    symbols[starts] = np.unique(hashes, return_inverse=True)[1] + 1
    return symbols


def transform(symbols: np.ndarray, places: np.ndarray, behind: np.ndarray,
              previous: np.ndarray) -> Transform:
    """Sort the suffixes at ``places`` by ``DEPTH`` symbols, doubling the sorted length."""
    size = len(symbols)
    rank = symbols[places]
    local = np.full(size + 1, -1, np.int64)
    local[places] = np.arange(len(places))
    step, jump = behind[places], 1
    while True:
        follow = np.where(step >= 0, local[np.maximum(step, 0)], -1)
        if jump == 1:
            order = stable_order(rank)
        if jump >= DEPTH:
            break
        behind_rank = np.where(follow >= 0, rank[np.maximum(follow, 0)] + 1, 0)
        order = stable_order(behind_rank)
        order = order[stable_order(rank[order])]
        key = rank[order] * (size + 2) + behind_rank[order]
        new = np.empty(len(places), np.int64)
        new[order] = np.append(0, np.cumsum(key[1:] != key[:-1])) if len(key) else 0
        rank = new
        step = np.where(follow >= 0, step[np.maximum(follow, 0)], -1)
        jump *= 2
    ordered = places[order]
    before = np.where(previous[ordered] >= 0, symbols[np.maximum(previous[ordered], 0)], -1)
    ranks = rank[order]
    common = np.where(np.append(False, ranks[1:] == ranks[:-1]), DEPTH, 0)
    return Transform(ordered, before, common)


def merge(left: Transform, right: Transform, symbols: np.ndarray, previous: np.ndarray,
          last: np.ndarray) -> Transform:
    """Merge two transforms by refining their interleave, one symbol a round.

    ``last`` marks places where nothing follows the symbol (suffixes of one symbol or none).
    """
    total = len(left.places) + len(right.places)
    if not total:
        return left
    source = np.concatenate([np.zeros(len(left.places), bool), np.ones(len(right.places), bool)])
    block = np.zeros(total, np.int64)      # suffixes equal in the symbols seen so far
    common = np.zeros(total, np.int64)
    before = {False: left.before, True: right.before}
    lasts = {side: np.sort(symbols[t.places[last[t.places]]])
             for side, t in ((False, left), (True, right))}
    for depth in range(1, DEPTH + 1):
        # Suffixes without a follower extend nothing: they are put first among their symbol.
        sequence = np.empty(total, np.int64)
        sequence[~source], sequence[source] = before[False], before[True]
        moving = np.flatnonzero(sequence >= 0)
        joined = np.concatenate([lasts[False], lasts[True], sequence[moving]])
        came = np.concatenate([np.zeros(len(lasts[False]), bool), np.ones(len(lasts[True]), bool),
                               source[moving]])
        old = np.concatenate([np.full(len(lasts[False]) + len(lasts[True]), -1), block[moving]])
        if depth == 1:
            old[:] = 0  # whether something follows the first symbol is not compared yet
        order = stable_order(joined)
        source, old, joined = came[order], old[order], joined[order]
        differs = np.append(True, (joined[1:] != joined[:-1]) | (old[1:] != old[:-1]))
        common[~differs] = depth
        block = np.cumsum(differs) - 1
    places = np.empty(total, np.int64)
    places[~source], places[source] = left.places, right.places
    sequence = np.empty(total, np.int64)
    sequence[~source], sequence[source] = before[False], before[True]
    return Transform(places, sequence, common)


def candidates(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of windows whose symbols all stand twice or more; no other can be repeated."""
    again = np.bincount(symbols)[symbols] > 1
    starts = np.zeros(len(symbols) + 1, np.int8)
    lengths = np.diff(offsets)
    np.add.at(starts, offsets[:-1][lengths >= WINDOW], 1)
    np.add.at(starts, offsets[1:][lengths >= WINDOW] - WINDOW + 1, -1)
    at = np.flatnonzero(np.cumsum(starts[:-1], dtype=np.int8))
    for step in range(0, WINDOW, STRIDE):
        at = at[again[at + step]]
    return at


def match_bytes(segments: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each segment with some: its windows that stand twice among the segments."""
    if not segments:
        return
    offsets = np.append(0, np.cumsum([len(s) for s in segments]))
    symbols = symbols_of(np.concatenate(segments), offsets)
    starts = candidates(symbols, offsets)
    # Only symbols of these windows are sorted; from here on places count them alone.
    used = np.zeros(len(symbols) + STRIDE, bool)
    for step in range(0, WINDOW, STRIDE):
        used[starts + step] = True
    number = np.cumsum(used) - 1
    at = np.flatnonzero(used)
    symbols = symbols[at]
    owner = np.searchsorted(offsets, at, "right") - 1
    near = at + STRIDE < offsets[owner + 1]
    behind = np.where(near & used[at + STRIDE], number[at + STRIDE], -1)
    previous = np.full(len(at), -1, np.int64)
    previous[behind[behind >= 0]] = np.flatnonzero(behind >= 0)
    part = np.minimum(owner * PARTS // len(segments), PARTS - 1)
    last = behind < 0
    whole = transform(symbols, np.flatnonzero(part == 0), behind, previous)
    for side in range(1, PARTS):
        other = transform(symbols, np.flatnonzero(part == side), behind, previous)
        whole = merge(whole, other, symbols, previous, last)
    same = whole.common >= DEPTH
    repeated = np.zeros(len(at), bool)
    repeated[whole.places] = same | np.append(same[1:], False)
    hits = starts[repeated[number[starts]]]
    cuts = np.searchsorted(hits, offsets)
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        yield i, hits[cuts[i]:cuts[i + 1]] - offsets[i]


BYTE_UNIT = Unit(words=False, window=WINDOW, gram=GRAM)


def without_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Every row with its bytes, removed bytes, spans and digest of the bytes that stay."""
    return removed(docs, BYTE_UNIT, match_bytes, SHARD_BYTES, keep_text)


def op5_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(id_and_text(table(spark, sf_dir, "documents")))
    return found.select("doc_id", found["n_units"].alias("n_bytes"), "n_removed", "n_spans",
                        "kept_sha256")
