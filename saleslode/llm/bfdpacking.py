"""Packing by best fit decreasing into id matrices of a fixed row length.

Documents are tokenised, closed by an end id and cut without loss into pieces of at most
``width`` ids. Pieces are dealt into bins of bounded size (by bytes of text); within one,
the longest goes first, each into the row with the least sufficient room, found by a
segment tree over the remaining capacities. A row of the result is a row of the matrix
with its cumulative segment lengths and the places where positions start again.

Edge cases: NULL and empty texts give the end id alone; repeated rows are packed each; NULL
ids are kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_column, id_and_text, list_column, map_arrow, mix, signed, table
from .tokens import END_OF_TEXT, token_ids, vocabulary_path

WIDTH = 2048
BIN_BYTES = 4 << 20
ROWS = ("row_id long, ids binary, n_tokens int, cu_seqlens array<int>, "
        "position_resets array<int>, doc_ids array<long>, starts array<long>")


class CapacityTree:
    """Counts of open rows by remaining room, with the least sufficient room in log time."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, room: int, change: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += change
            at >>= 1

    def put(self, room: int, row: int) -> None:
        if room:
            self.rows[room].append(row)
            self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) with the smallest room of at least ``need``, removed from the tree."""
        at = need + self.leaves
        while not self.count[at]:
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: np.ndarray, width: int) -> list[list[int]]:
    """Items of each row; every item is at most ``width``."""
    tree, rows = CapacityTree(width), []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        found = tree.take(size)
        if found is None:
            rows.append([item])
            tree.put(width - size, len(rows) - 1)
        else:
            room, row = found
            rows[row].append(item)
            tree.put(room - size, row)
    return rows


def pack_matrices(docs: DataFrame, width: int = WIDTH, bin_bytes: int = BIN_BYTES,
                  end_id: int = END_OF_TEXT, path: str | None = None) -> DataFrame:
    """One row per matrix row: ``ids`` are ``width`` little-endian 32-bit ids, padded by the end
    id; ``cu_seqlens`` bounds the segments (0 first, ``n_tokens`` last); positions start
    again at ``position_resets``; ``doc_ids`` and ``starts`` say what each segment is."""
    path = path or vocabulary_path()
    size = docs.agg(F.sum(F.octet_length("text") + F.lit(1))).first()[0] or 0
    bins = max(1, -(-int(size) // bin_bytes))

    def cut(batch):
        ids_of, docs_of, starts = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.append(token_ids(text.as_py(), path), np.uint16(end_id))
            for start in range(0, len(ids), width):
                ids_of.append(ids[start:start + width])
                docs_of.append(doc)
                starts.append(start)
        place = np.arange(len(starts), dtype=np.uint64)
        known = np.array([d or 0 for d in docs_of], np.int64).view(np.uint64)
        key = mix(mix(known) ^ np.array(starts, np.uint64) ^ (place << np.uint64(32)))
        yield {"bin": signed(key % np.uint64(bins)), "doc_id": docs_of, "start": starts,
               "ids": binary_column(ids_of)}

    pieces = map_arrow(docs, cut, "bin long, doc_id long, start long, ids binary")

    def arrange(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending"),
                               ("ids", "ascending")])
        parts = [np.frombuffer(x.as_buffer(), np.uint16)
                 for x in group["ids"].combine_chunks()]
        sizes = np.array([len(p) for p in parts], np.int64)
        rows = best_fit_decreasing(sizes, width)
        flat = np.array([i for row in rows for i in row], np.int64)
        counts = np.array([len(row) for row in rows], np.int64)
        matrix, bounds, resets = [], [], []
        for row in rows:
            ids = np.full(width, end_id, np.uint32)
            ends = np.cumsum(sizes[row])
            ids[:ends[-1]] = np.concatenate([parts[i] for i in row])
            matrix.append(ids)
            bounds.append(np.append(0, ends))
            resets.append(np.append(0, ends[:-1]))
        base = int(group["bin"][0].as_py()) << 24
        taken = group.select(["doc_id", "start"]).take(pa.array(flat))
        ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
        return pa.table({
            "row_id": base + np.arange(len(rows)),
            "ids": binary_column(matrix),
            "n_tokens": np.array([b[-1] for b in bounds], np.int32),
            "cu_seqlens": list_column(np.concatenate(bounds).astype(np.int32), counts + 1),
            "position_resets": list_column(np.concatenate(resets).astype(np.int32), counts),
            "doc_ids": pa.ListArray.from_arrays(ends, taken["doc_id"].combine_chunks()),
            "starts": pa.ListArray.from_arrays(ends, taken["start"].combine_chunks()),
        })

    return pieces.groupBy("bin").applyInArrow(arrange, ROWS)


def op2_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_matrices(id_and_text(table(spark, sf_dir, "documents")))
