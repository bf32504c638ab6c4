"""Packing by Karmarkar-Karp multiway differencing into windows of nearly equal length.

A document's ids (with the end id 0 after them) are cut into pieces of at most
``window`` tokens; the rest after whole windows is cut evenly into pieces of at most
``piece`` tokens, so that differencing has small enough parts to level. Whole-window
pieces fill a window each. The others are dealt by a stored row number into groups of
about ``GROUP_ROWS``, and every group is packed by itself: partial partitions are merged
by their imbalance, the fullest parts of one meeting the emptiest of the other, until
one partition into windows is left. If its fullest window exceeds the capacity, the
number of windows rises and the group is packed again.

Windows are padded to ``window`` except at a power of two. A group leaves less than
about three windows' worth of padding.

Edge cases: NULL and empty texts are one piece, the end id alone; repeated rows are packed
each; NULL ids are kept; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, map_arrow, stored, table
from .tokens import token_ids, vocabulary_path

WINDOW = 1024
PIECE = 128
GROUP_ROWS = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_lengths(tokens: int, window: int, piece: int) -> np.ndarray:
    """Lengths of a document's pieces: whole windows, then nearly equal smaller ones."""
    whole, rest = divmod(tokens, window)
    parts = -(-rest // piece)
    small = np.full(parts, rest // parts if parts else 0, np.int64)
    if parts:
        small[:rest % parts] += 1
    return np.concatenate([np.full(whole, window, np.int64), small])


def difference_partition(sizes: np.ndarray, windows: int) -> list[np.ndarray]:
    """Karmarkar-Karp: items of each window, for as equal sums as differencing gives.

    A partial partition is its windows' sums in falling order, less the smallest, and the
    lists of items as a binary tree; zero sums are not stored.
    """
    left, right = [], []
    count = len(sizes)
    heap = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        heap.append((-int(sizes[i]), i, np.array([sizes[i]], np.int64), np.array([i], np.int64)))
    heapq.heapify(heap)
    tick = count
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, more, other = heapq.heappop(heap)
        both = len(sums) + len(more) - windows
        if both <= 0:
            total, joined = np.concatenate([sums, more]), np.concatenate([nodes, other])
        else:
            # the last ``both`` of one meet, in opposite order, the last of the other
            keep, rest = len(sums) - both, len(more) - both
            met = sums[keep:] + more[rest:][::-1]
            fresh = np.arange(count + len(left), count + len(left) + both)
            left.extend(nodes[keep:].tolist())
            right.extend(other[rest:][::-1].tolist())
            total = np.concatenate([sums[:keep], met, more[:rest]])
            joined = np.concatenate([nodes[:keep], fresh, other[:rest]])
        order = np.argsort(-total, kind="stable")
        total, joined = total[order], joined[order]
        if len(total) == windows and total[-1]:
            total = total - total[-1]
        tick += 1
        heapq.heappush(heap, (-int(total[0]), tick, total, joined))
    result = []
    for node in (heap[0][3].tolist() if heap else []):
        items, stack = [], [node]
        while stack:
            at = stack.pop()
            if at < count:
                items.append(at)
            else:
                stack += (left[at - count], right[at - count])
        result.append(np.array(sorted(items), np.int64))
    return result


def level_windows(sizes: np.ndarray, window: int) -> list[np.ndarray]:
    """Fewest windows, counting up from the sum, at which no window exceeds the capacity."""
    count = max(1, -(-int(sizes.sum()) // window)) if len(sizes) else 0
    while count:
        parts = difference_partition(sizes, count)
        if max(int(sizes[p].sum()) for p in parts) <= window:
            return parts
        count += 1
    return []


def pieces_of(docs: DataFrame, window: int, piece: int, end_id: int, path: str) -> DataFrame:
    def cut(batch):
        out = {name: [] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.append(token_ids(text.as_py(), path).astype("<u4"), np.uint32(end_id))
            start = 0
            for length in cut_lengths(len(ids), window, piece).tolist():
                values = (doc, start, length, zlib.crc32(ids[start:start + length].tobytes()),
                          len(ids))
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
                start += length
        yield out

    return map_arrow(docs, cut, PIECES)


def pack(docs: DataFrame, window: int = WINDOW, piece: int = PIECE, end_id: int = 0,
         path: str | None = None) -> DataFrame:
    """Every piece with its ``sequence_id`` and its ``offset`` there."""
    pieces = pieces_of(docs, window, piece, end_id, path or vocabulary_path())
    # Row numbers are fixed by the stored copy, so a lost task deals alike when run again.
    rows = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.count() // GROUP_ROWS))
    dealt = rows.withColumn("bin", F.pmod(F.xxhash64("row"), F.lit(groups)))
    fields = [*rows.drop("row").schema.fieldNames(), "sequence_id", "offset"]
    schema = PIECES + ", sequence_id long, offset long"

    def arrange(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        sizes = group["length"].to_numpy()
        whole = np.flatnonzero(sizes == window)
        small = np.flatnonzero(sizes < window)
        parts = [np.array([i]) for i in whole] + [small[p] for p in
                                                 level_windows(sizes[small], window)]
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        base = int(group["bin"][0].as_py()) << 20
        for number, members in enumerate(parts):
            sequence[members] = base + number
            offset[members] = np.cumsum(sizes[members]) - sizes[members]
        group = group.drop(["row", "bin"])
        return (group.append_column("sequence_id", pa.array(sequence))
                .append_column("offset", pa.array(offset)).select(fields))

    return dealt.groupBy("bin").applyInArrow(arrange, schema)


def windows_of(packed: DataFrame, docs: DataFrame, end_id: int = 0,
               path: str | None = None) -> DataFrame:
    """The packed windows themselves: sequence_id, ids, offsets of the pieces, documents.

    Texts meet their pieces by document id, so ids must be unique here.
    """
    path = path or vocabulary_path()
    lists = packed.groupBy("doc_id").agg(
        F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("parts"))
    joined = id_and_text(docs).join(lists, "doc_id").select("doc_id", "text", "parts")

    def fill(batch):
        out = {"doc_id": [], "sequence_id": [], "offset": [], "ids": []}
        for row in batch.to_pylist():
            ids = np.append(token_ids(row["text"], path).astype("<u4"), np.uint32(end_id))
            for part in row["parts"]:
                out["doc_id"].append(row["doc_id"])
                out["sequence_id"].append(part["sequence_id"])
                out["offset"].append(part["offset"])
                out["ids"].append(ids[part["start"]:part["start"] + part["length"]].tolist())
        yield out

    filled = map_arrow(joined, fill, "doc_id long, sequence_id long, offset long, ids array<long>")
    return (filled.groupBy("sequence_id")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
            .select("sequence_id", F.flatten("p.ids").alias("ids"),
                    F.col("p.offset").alias("offsets"), F.col("p.doc_id").alias("doc_ids")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(id_and_text(table(spark, sf_dir, "documents")))
