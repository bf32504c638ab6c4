"""Alignment of two tokenizers by products of token-byte incidence matrices.

A text is encoded twice, by A (byte-level pairs) and B (pieces). Each side gives a matrix in
compressed rows, built here: a row per token, a column per byte of the text, ones where the
token covers the byte. The documents of a block stand below one another, as one
block-diagonal matrix.

* **Overlap links** are the non-zeros of A x B^T, by Gustavson's row products: a row of the
  result gathers the rows of B^T that the token's bytes select, and equal columns are summed;
  the sum is the number of bytes that both tokens cover.
* **Groups** are the stretches between byte offsets where tokens of both sides end. Group-token
  incidence matrices G_A and G_B hold their tokens, and G_A^T x G_B the pairs that share a
  group. Their number follows from the rows' lengths, so that a text whose tokens never end
  together is counted, not expanded; ``shared_groups`` expands them in bounded steps.

The corpus-wide count of an id pair is the number of documents that hold it linked. A
document's distinct pairs are stored once, compressed, beside its figures; tasks count pairs
by themselves before the shuffle. For the sums over links the pair table, cut into ranges of
the A id's hash of at most about ``PAIRS_A_PART`` pairs, meets groups of documents' pairs of
about ``LINKS_A_GROUP``: neither the documents of a frequent pair nor the table are in one task.

Edge cases: texts that are NULL, empty, or that a side does not give back byte by byte have
no tokens (zeros, an empty ``groups_sha256``); repeated rows count and are reported each; NULL
ids are kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, map_arrow, stored, table
from .tokens import token_bytes, token_ids, vocabulary_path

PIECES_NAME = "piece_bpe_32k.model"
SPACE_MARK = "▁"
BLOCK = 1 << 18
LINKS_A_GROUP = 4_000_000
PAIRS_A_PART = 4_000_000
CHUNK = 1_000_000
FIGURES = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, "
           "n_shared_group_links long, groups_sha256 string")


class Matrix:
    """A sparse matrix in compressed rows."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.starts, self.columns, self.values, self.width = starts, columns, values, width

    @classmethod
    def of_runs(cls, ends: np.ndarray) -> Matrix:
        """Rows that cover consecutive runs of columns and end at ``ends``."""
        size = int(ends[-1]) if len(ends) else 0
        starts = np.concatenate([np.zeros(1, np.int64), ends.astype(np.int64)])
        return cls(starts, np.arange(size), np.ones(size, np.int64), size)

    def row_of_each(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def transpose(self) -> Matrix:
        order = np.argsort(self.columns, kind="stable")
        starts = np.zeros(self.width + 1, np.int64)
        np.cumsum(np.bincount(self.columns, minlength=self.width), out=starts[1:])
        return Matrix(starts, self.row_of_each()[order], self.values[order], len(self.starts) - 1)

    def rows(self, first: int, end: int) -> Matrix:
        low, high = self.starts[first], self.starts[end]
        return Matrix(self.starts[first:end + 1] - low, self.columns[low:high],
                      self.values[low:high], self.width)

    def __matmul__(self, other: Matrix) -> Matrix:
        """Gustavson: each row gathers the other's rows at its columns, equal columns add up."""
        first = other.starts[self.columns]
        lengths = other.starts[self.columns + 1] - first
        before = np.cumsum(lengths) - lengths
        at = np.repeat(first - before, lengths) + np.arange(int(lengths.sum()))
        row = np.repeat(self.row_of_each(), lengths)
        value = np.repeat(self.values, lengths) * other.values[at]
        key = row * max(other.width, 1) + other.columns[at]
        if len(key) and (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(new)
        key = key[heads]
        starts = np.searchsorted(key, np.arange(len(self.starts)) * max(other.width, 1))
        summed = np.add.reduceat(value, heads) if len(heads) else value
        return Matrix(starts, key % max(other.width, 1), summed, other.width)


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECES_NAME)


class Pair:
    """The two tokenizers: ids of a text, bytes of an id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a_path = a_path
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        count = self.b.get_piece_size()
        self.a_bytes = token_bytes(a_path)
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace(SPACE_MARK, " ").encode()
                        for i in range(count)]
        self.a_size = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], np.int64)
        if len(self.a_bytes) * count >= 1 << 32:
            raise ValueError("pairs of ids are held in 32 bits")
        # texts of an id by what follows it: more of its list, or the list's end
        self.a_text = np.array([f"{i}{e}" for i in range(len(self.a_bytes)) for e in ",|"], object)
        self.b_text = np.array([f"{i}{e}" for i in range(count) for e in ",;"], object)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or None where a side does not give the text back."""
        if not text:
            return None
        a = token_ids(" " + text, self.a_path).astype(np.int64)
        b = np.array(self.b.encode(text), np.int64)
        whole = (" " + text).encode()
        if (b"".join([self.a_bytes[i] for i in a.tolist()]) != whole
                or b"".join([self.b_bytes[i] for i in b.tolist()]) != whole):
            return None
        return a, b


@lru_cache(maxsize=1)
def tokenizer_pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


class Aligned:
    """A block of documents: ids of both sides, links and groups; tokenless ones are empty."""

    def __init__(self, texts: list[str | None], pair: Pair):
        none = np.zeros(0, np.int64)
        sides = [pair.encode(t) or (none, none) for t in texts]
        self.pair = pair
        self.a = np.concatenate([s[0] for s in sides] or [none])
        self.b = np.concatenate([s[1] for s in sides] or [none])
        self.a_first = np.cumsum([0, *[len(s[0]) for s in sides]])
        self.b_first = np.cumsum([0, *[len(s[1]) for s in sides]])
        a_ends, b_ends = np.cumsum(pair.a_size[self.a]), np.cumsum(pair.b_size[self.b])
        self.links = Matrix.of_runs(a_ends) @ Matrix.of_runs(b_ends).transpose()
        # documents end on both sides, so no group crosses them
        both = np.intersect1d(a_ends, b_ends)
        self.a_groups = Matrix.of_runs(np.searchsorted(a_ends, both) + 1)
        self.b_groups = Matrix.of_runs(np.searchsorted(b_ends, both) + 1)
        self.g_first = np.searchsorted(self.a_groups.starts, self.a_first)

    def link_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of both sides of every link."""
        return self.links.row_of_each(), self.links.columns

    def group_text(self, doc: int) -> str:
        """``a1,a2|b1;a3|b2,b3``: ids of each group's tokens in order."""
        low, high = self.g_first[doc], self.g_first[doc + 1]
        if low == high:
            return ""
        parts, orders = [], []
        for ids, groups, texts in ((self.a, self.a_groups, self.pair.a_text),
                                   (self.b, self.b_groups, self.pair.b_text)):
            first, end = groups.starts[low], groups.starts[high]
            last = np.zeros(end - first, np.int64)
            last[groups.starts[low + 1:high + 1] - 1 - first] = 1
            parts.append(texts[2 * ids[first:end] + last])
            side = 2 * (np.cumsum(last) - last) + len(orders)
            orders.append(side)
        merged = np.concatenate(parts)[np.argsort(np.concatenate(orders), kind="stable")]
        return "".join(merged.tolist())[:-1]


def aligned_blocks(batch: pa.RecordBatch, pair: Pair) -> Iterator[tuple[list, Aligned]]:
    """(ids, alignment) of whole documents of about ``BLOCK`` characters at a time."""
    ids, texts, size = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        text = text.as_py()
        ids.append(doc)
        texts.append(text)
        size += len(text or "")
        if size >= BLOCK:
            yield ids, Aligned(texts, pair)
            ids, texts, size = [], [], 0
    if ids:
        yield ids, Aligned(texts, pair)


def packed_numbers(values: np.ndarray) -> bytes:
    return pa.compress(values.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def unpacked_numbers(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * count, codec="zstd", asbytes=True), "<u4")


def figures(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Figures of each document with its distinct linked id pairs and their links."""

    def measure(batch):
        pair = tokenizer_pair(a_path, b_path)
        wide = len(pair.b_bytes)
        for ids, block in aligned_blocks(batch, pair):
            left, right = block.link_pairs()
            codes = block.a[left] * wide + block.b[right]
            rows = np.arange(len(ids))
            bounds = block.links.starts[block.a_first]
            shared = np.diff(block.a_groups.starts) * np.diff(block.b_groups.starts)
            before = np.concatenate([np.zeros(1, np.int64), np.cumsum(shared)])
            found = [np.unique(codes[bounds[i]:bounds[i + 1]], return_counts=True) for i in rows]
            texts = [block.group_text(i) for i in rows]
            yield {
                "doc_id": ids, "n_a": np.diff(block.a_first), "n_b": np.diff(block.b_first),
                "n_groups": np.diff(block.g_first), "n_links": np.diff(bounds),
                "n_shared_group_links": np.diff(before[block.g_first]),
                "groups_sha256": [hashlib.sha256(t.encode()).hexdigest() if t else ""
                                  for t in texts],
                "n_pairs": [len(c) for c, _ in found],
                "pairs": [packed_numbers(c) for c, _ in found],
                "times": [packed_numbers(n) for _, n in found],
            }

    return map_arrow(docs, measure, FIGURES + ", n_pairs long, pairs binary, times binary")


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """(pair, a_id, documents, is_best): documents that hold the pair, best of its A id."""

    def count(batch):
        waiting, size = [], 0

        def counted():
            codes, times = np.unique(np.concatenate(waiting), return_counts=True)
            return {"pair": codes.astype(np.int64), "documents": times}

        for n, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            waiting.append(unpacked_numbers(data.as_py(), n))
            size += n
            if size >= CHUNK:
                yield counted()
                waiting, size = [], 0
        if waiting:
            yield counted()

    partial = map_arrow(rows.select("n_pairs", "pairs"), count, "pair long, documents long")
    total = partial.groupBy("pair").agg(F.sum("documents").alias("documents"))
    total = total.withColumn("a_id", F.floor(F.col("pair") / b_size).cast("long"))
    most = F.max("documents").over(Window.partitionBy("a_id"))
    return total.withColumn("is_best", F.col("documents") == most)


def link_sums(rows: DataFrame, counts: DataFrame, b_size: int) -> DataFrame:
    """(row, count_sum, n_best) of each stored row, by meeting groups with table parts."""
    total = rows.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-counts.count() // PAIRS_A_PART))
    groups = max(1, -(-total // LINKS_A_GROUP))

    def split(batch):
        for row, group, n, pairs, times in zip(*[c.to_pylist() for c in batch.columns],
                                               strict=True):
            codes, links = unpacked_numbers(pairs, n), unpacked_numbers(times, n)
            part = (codes // b_size) * np.uint32(2654435761) % np.uint32(parts)
            held = np.unique(part)
            chosen = [part == p for p in held]
            yield {"row": [row] * len(held), "group": [group] * len(held), "part": held,
                   "n_pairs": [int(c.sum()) for c in chosen],
                   "pairs": [packed_numbers(codes[c]) for c in chosen],
                   "times": [packed_numbers(links[c]) for c in chosen]}

    dealt = rows.where("n_pairs > 0").select(
        "row", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"), "n_pairs", "pairs", "times")
    if parts > 1:
        dealt = map_arrow(dealt.select("row", "group", "n_pairs", "pairs", "times"), split,
                          "row long, group long, part long, n_pairs long, pairs binary, "
                          "times binary")
    else:
        dealt = dealt.withColumn("part", F.lit(0).cast("long"))
    code = F.pmod(F.pmod(F.col("a_id") * 2654435761, F.lit(1 << 32)), F.lit(parts))
    tables = counts.select("pair", "documents", "is_best", code.alias("part"),
                           F.explode(F.sequence(F.lit(0).cast("long"),
                                                F.lit(groups - 1).cast("long"))).alias("group"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("pair")
        keys, documents = right["pair"].to_numpy(), right["documents"].to_numpy()
        best = right["is_best"].to_numpy(zero_copy_only=False)
        sums, bests = [], []
        for n, pairs, times in zip(left["n_pairs"].to_pylist(), left["pairs"], left["times"],
                                   strict=True):
            at = np.searchsorted(keys, unpacked_numbers(pairs.as_py(), n).astype(np.int64))
            links = unpacked_numbers(times.as_py(), n).astype(np.int64)
            sums.append(int((documents[at] * links).sum()))
            bests.append(int(links[best[at]].sum()))
        return pa.table({"row": left["row"], "count_sum": pa.array(sums, pa.int64()),
                         "n_best": pa.array(bests, pa.int64())})

    met = (dealt.groupBy("group", "part").cogroup(tables.groupBy("group", "part"))
           .applyInArrow(meet, "row long, count_sum long, n_best long"))
    if parts == 1:
        return met
    return met.groupBy("row").agg(F.sum("count_sum").alias("count_sum"),
                                  F.sum("n_best").alias("n_best"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Figures of every document with sums over its links of corpus-wide counts."""
    a_path, b_path = a_path or vocabulary_path(), b_path or pieces_path()
    b_size = len(tokenizer_pair(a_path, b_path).b_bytes)
    rows = stored(figures(docs, a_path, b_path)
                  .withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(rows, b_size), "alignedpairs")
    sums = link_sums(rows, counts, b_size)
    zero = F.lit(0).cast("long")
    return (rows.drop("n_pairs", "pairs", "times").join(sums, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links",
                    F.coalesce("n_best", zero).alias("n_best"),
                    F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
                    "n_shared_group_links"))


def overlaps(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Every overlap link: doc_id, places and ids of both tokens, bytes that both cover."""
    a_path, b_path = a_path or vocabulary_path(), b_path or pieces_path()

    def listed(batch):
        for ids, block in aligned_blocks(batch, tokenizer_pair(a_path, b_path)):
            left, right = block.link_pairs()
            doc = np.searchsorted(block.a_first, left, "right") - 1
            yield {"doc_id": [ids[d] for d in doc.tolist()], "a_at": left - block.a_first[doc],
                   "b_at": right - block.b_first[doc], "a_id": block.a[left],
                   "b_id": block.b[right], "shared_bytes": block.links.values}

    return map_arrow(docs, listed, "doc_id long, a_at long, b_at long, a_id long, b_id long, "
                                   "shared_bytes long")


def shared_groups(docs: DataFrame, a_path: str | None = None,
                  b_path: str | None = None) -> DataFrame:
    """Every pair of tokens in one group: doc_id, places and ids of both, by G_A^T x G_B.

    Rows of the product are expanded at most about ``CHUNK`` entries at a time.
    """
    a_path, b_path = a_path or vocabulary_path(), b_path or pieces_path()

    def listed(batch):
        for ids, block in aligned_blocks(batch, tokenizer_pair(a_path, b_path)):
            groups = block.a_groups.transpose()
            sizes = np.cumsum(np.diff(block.b_groups.starts)[groups.columns])
            first = 0
            while first < len(sizes):
                done = sizes[first - 1] if first else 0
                end = max(first + 1, int(np.searchsorted(sizes, done + CHUNK, "right")))
                product = groups.rows(first, end) @ block.b_groups
                left, right = product.row_of_each() + first, product.columns
                doc = np.searchsorted(block.a_first, left, "right") - 1
                yield {"doc_id": [ids[d] for d in doc.tolist()],
                       "a_at": left - block.a_first[doc], "b_at": right - block.b_first[doc],
                       "a_id": block.a[left], "b_id": block.b[right]}
                first = end

    return map_arrow(docs, listed, "doc_id long, a_at long, b_at long, a_id long, b_id long")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(id_and_text(table(spark, sf_dir, "documents")))
