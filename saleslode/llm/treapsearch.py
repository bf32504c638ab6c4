"""Ranked lexical search over K2-treaps of the term-document grid.

Terms are rows of a grid, the documents of a shard its columns, and a point's value is the
impact of the term in the document. The grid is cut in four again and again; cells without
points are left out, and every other cell keeps the largest impact inside and one bit for each
quarter that has points, so a child is found by counting bits. Rows are spread evenly over the
grid's height, in order of rarity: from some level on a cell holds one term only.

An item's terms descend together. A state is a range of documents with the cell of each of
the item's terms over that range; the sum of weight times largest impact bounds every score
in the range. The state of the highest bound is halved first, several at a time, until
no state's bound reaches the tenth best score. A bound at the last level is the exact score.
The best ten of an item found so far in a task raise the bar for its next shards, and the tasks'
tens are ranked at the end.

Terms are runs of ASCII digits, ASCII letters (A-Z lower-cased) and bytes above 0x7F. The
index holds the terms it is built for, told apart by 128 bits of hash. Items are the query set:
they reach the tasks in blocks of about ``ITEM_BYTES`` of text, one pass over the documents
each. Documents are never gathered: a shard ends at ``SHARD_DOCS`` documents or
``SHARD_POINTS`` points.

Edge cases: NULL and empty texts, and those without a term, are not counted and never found;
repeated rows are ranked each; NULL document ids rank behind others of their score; rows of
one item id are one item with the terms of all its texts, NULL item ids are left out; items
without terms or hits, and empty tables, give no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import (
    LOWER,
    Words,
    byte_blocks,
    id_and_text,
    map_arrow,
    map_stream,
    mix,
    prefix_sums,
    run_hashes,
    stored,
    table,
)

TOP = 10
ITEM_BYTES = 8 << 20
SHARD_DOCS, SHARD_POINTS = 8192, 2_000_000
STATES_AT_ONCE = 64
SEPARATOR = np.ones(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    SEPARATOR[_low:_high] = False
_U = np.uint64
_SECOND_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA0761D6478BD642F))


class Terms:
    """Distinct terms by two hashes, sorted by the first."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        self.first, self.second = first[new], second[new]

    def __len__(self) -> int:
        return len(self.first)

    def numbers(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Number of each given term, -1 for one that is not held."""
        found = np.full(len(first), -1, np.int64)
        at = np.searchsorted(self.first, first)
        open_ = np.flatnonzero(at < len(self))
        while len(open_):
            same = self.first[at[open_]] == first[open_]
            hit = same & (self.second[at[open_]] == second[open_])
            found[open_[hit]] = at[open_[hit]]
            # equal first hashes of different terms stand side by side
            open_ = open_[same & ~hit]
            at[open_] += 1
            open_ = open_[at[open_] < len(self)]
        return found


def hashed_terms(block: np.ndarray, offsets: np.ndarray):
    """(first term of each document, first hash, second hash) of a block's terms in order."""
    lowered = LOWER[block]
    words = Words(lowered, offsets, SEPARATOR)
    second = run_hashes(prefix_sums(_SECOND_VALUE[lowered]), words.starts, words.ends)
    return words.first, words.hashes(), second


class Items:
    """A block of items: ids, the terms of all, and each item's distinct term numbers."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids = list(dict.fromkeys(ids))
        place = {item: n for n, item in enumerate(self.ids)}
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum([0, *[len(t) for t in texts]])
        first, a, b = hashed_terms(data, offsets)
        self.terms = Terms(a, b)
        numbers = self.terms.numbers(a, b)
        owner = np.repeat([place[i] for i in ids], np.diff(first))
        pairs = np.unique(owner * max(len(self.terms), 1) + numbers)
        owners, numbers = np.divmod(pairs, max(len(self.terms), 1))
        ends = np.searchsorted(owners, np.arange(len(self.ids) + 1))
        self.rows = [numbers[ends[i]:ends[i + 1]] for i in range(len(self.ids))]


def item_blocks(items: DataFrame, limit: int = ITEM_BYTES) -> Iterator[Items]:
    """Blocks of whole items of about ``limit`` bytes of text, read one at a time."""
    ids, texts, size = [], [], 0
    held = items.where("item_id is not null").select(
        "item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for row in held.orderBy("item_id").toLocalIterator():
        if size >= limit and row["item_id"] != ids[-1]:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"].encode())
        size += len(texts[-1])
    if ids:
        yield Items(ids, texts)


def numbers_column(values: np.ndarray) -> bytes:
    return values.astype("<u4").tobytes()


def postings(docs: DataFrame, terms: Terms) -> DataFrame:
    """(doc_id, n, terms, times): a document's number of terms, and the held ones it has."""

    def read(batch):
        ids = batch.column(0).to_pylist()
        for first, end, block, offsets in byte_blocks(batch.column(1)):
            starts, a, b = hashed_terms(block, offsets)
            numbers = terms.numbers(a, b)
            doc = np.repeat(np.arange(end - first), np.diff(starts))
            held = numbers >= 0
            pairs, times = np.unique(doc[held] * len(terms) + numbers[held], return_counts=True)
            bounds = np.searchsorted(pairs, np.arange(end - first + 1) * len(terms))
            pairs %= len(terms)
            yield {"doc_id": ids[first:end], "n": np.diff(starts),
                   "terms": [numbers_column(pairs[i:j]) for i, j in zip(bounds, bounds[1:])],
                   "times": [numbers_column(times[i:j]) for i, j in zip(bounds, bounds[1:])]}

    return map_arrow(docs, read, "doc_id long, n long, terms binary, times binary")


def statistics(rows: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, their terms in all, and documents of each held term.

    One number per term of a block of items comes to the driver.
    """
    def count(batches):
        held = np.zeros(size, np.int64)
        for batch in batches:
            for data in batch.column(0):
                held[np.frombuffer(data.as_py(), "<u4")] += 1
        seen = np.flatnonzero(held)
        yield {"term": seen, "documents": held[seen]}

    whole = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    counted = np.zeros(size, np.int64)
    partial = map_stream(rows.select("terms"), count, "term long, documents long")
    for row in partial.groupBy("term").agg(F.sum("documents").alias("n")).collect():
        counted[row["term"]] = row["n"]
    return whole["docs"], whole["terms"] or 0, counted


def weights(documents: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1)))
                     for n in held], np.int64)


def impacts(times: np.ndarray, lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Impact of a term ``times`` times in a document of ``lengths`` terms; whole numbers."""
    m = 100 - 90 + (90 * lengths * documents) // terms
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


def spread_bits(values: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2**31, a zero before each."""
    x = values.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF),
                        (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333),
                        (1, 0x5555555555555555)):
        x = (x | (x << _U(shift))) & _U(mask)
    return x


class Treap:
    """Levels of a K2-treap: quarter bits of each cell and largest impact of each cell."""

    def __init__(self, depth: int, stretch: int, quarters: list[np.ndarray],
                 largest: list[np.ndarray]):
        self.depth, self.stretch, self.largest = depth, stretch, largest
        self.quarters = quarters
        self.child = []
        for bits in quarters:
            ranks = np.cumsum(bits, dtype=np.int64) - 1
            self.child.append(np.where(bits > 0, ranks, -1))

    @classmethod
    def build(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int,
              width: int) -> Treap:
        tall, wide = max(height - 1, 0).bit_length(), max(width - 1, 0).bit_length()
        depth = max(tall, wide)
        stretch = depth - tall
        code = (spread_bits(rows << stretch) << _U(1)) | spread_bits(columns)
        order = np.argsort(code, kind="stable")
        code, value = code[order], values[order].astype(np.int64)
        quarters, largest = [], [value]
        for _ in range(depth):
            above = code >> _U(2)
            new = np.ones(len(above), bool)
            new[1:] = above[1:] != above[:-1]
            heads = np.flatnonzero(new)
            bits = np.zeros(4 * len(heads), np.uint8)
            bits[4 * (np.cumsum(new) - 1) + (code & _U(3)).astype(np.int64)] = 1
            quarters.append(bits)
            value = np.maximum.reduceat(value, heads) if len(heads) else value
            largest.append(value)
            code = above[heads]
        return cls(depth, stretch, quarters[::-1], largest[::-1])

    def packed(self) -> dict:
        return {"depth": self.depth, "stretch": self.stretch,
                "quarters": [np.packbits(q).tobytes() for q in self.quarters],
                "largest": [v.astype("<u4").tobytes() for v in self.largest]}

    @classmethod
    def unpacked(cls, depth: int, stretch: int, quarters: list[bytes],
                 largest: list[bytes]) -> Treap:
        values = [np.frombuffer(v, "<u4").astype(np.int64) for v in largest]
        bits = [np.unpackbits(np.frombuffer(q, np.uint8))[:4 * len(v)]
                for q, v in zip(quarters, values)]
        return cls(depth, stretch, bits, values)

    def bounds(self, level: int, cells: np.ndarray, weight: np.ndarray) -> np.ndarray:
        held = cells >= 0
        values = np.where(held, self.largest[level][np.where(held, cells, 0)], 0)
        return values @ weight

    def halves(self, level: int, cells: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Cells of both halves of each state (states, 2, terms), one level further down."""
        bit = (rows << self.stretch) >> (self.depth - 1 - level) & 1
        held = cells >= 0
        at = np.where(held, 4 * cells + 2 * bit, 0)
        found = np.stack([self.child[level][at], self.child[level][at + 1]], axis=1)
        return np.where(held[:, None, :], found, -1)


class Best:
    """The best documents of one item so far."""

    def __init__(self, top: int):
        self.top, self.found, self.bar = top, [], 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.found += [(-s, d is None, d or 0) for s, d in zip(scores.tolist(), ids)]
        self.found.sort()
        del self.found[self.top:]
        if len(self.found) == self.top:
            self.bar = -self.found[-1][0]


def descend(treap: Treap, rows: np.ndarray, weight: np.ndarray, ids: list, best: Best,
            at_once: int = STATES_AT_ONCE) -> int:
    """Adds a shard's documents that an item may rank; returns the number of states halved."""
    if not len(treap.largest[0]):
        return 0
    first = np.zeros((1, len(rows)), np.int64)
    waiting, tick, halved = [], 0, 0

    def take(level: int, columns: np.ndarray, cells: np.ndarray) -> None:
        nonlocal tick
        bounds = treap.bounds(level, cells, weight)
        chosen = np.flatnonzero(bounds >= best.bar)
        if level == treap.depth:
            best.add(bounds[chosen], [ids[c] for c in columns[chosen].tolist()])
            return
        for i in chosen.tolist():
            tick += 1
            heapq.heappush(waiting, (-int(bounds[i]), tick, level, int(columns[i]), cells[i]))

    take(0, np.zeros(1, np.int64), first)
    while waiting and -waiting[0][0] >= best.bar:
        taken = {}
        for _ in range(min(at_once, len(waiting))):
            bound, _, level, column, cells = heapq.heappop(waiting)
            if -bound < best.bar:
                break
            taken.setdefault(level, []).append((column, cells))
        for level, states in sorted(taken.items(), reverse=True):
            halved += len(states)
            columns = np.array([c for c, _ in states], np.int64)
            halves = treap.halves(level, np.stack([c for _, c in states]), rows)
            both = (columns[:, None] * 2 + np.arange(2)).reshape(-1)
            take(level + 1, both, halves.reshape(-1, len(rows)))
    return halved


INDEX = ("ids array<long>, depth int, stretch int, quarters array<binary>, "
         "largest array<binary>")


def build_index(rows: DataFrame, order: np.ndarray, documents: int, terms: int,
                shard_docs: int = SHARD_DOCS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """One row per shard: document ids and the treap. ``order`` gives each term's grid row."""
    size = len(order)

    def build(batches):
        ids, lengths, numbers, times, points = [], [], [], [], 0

        def shard():
            counts = np.array([len(n) for n in numbers], np.int64)
            columns = np.repeat(np.arange(len(ids)), counts)
            number, time = np.concatenate(numbers), np.concatenate(times).astype(np.int64)
            value = impacts(time, np.repeat(np.array(lengths, np.int64), counts), documents, terms)
            treap = Treap.build(order[number], columns, value, size, len(ids))
            return {"ids": [list(ids)], **{k: [v] for k, v in treap.packed().items()}}

        for batch in batches:
            for doc, n, held, seen in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids.append(doc)
                lengths.append(n)
                numbers.append(np.frombuffer(held, "<u4"))
                times.append(np.frombuffer(seen, "<u4"))
                points += len(numbers[-1])
                if len(ids) >= shard_docs or points >= shard_points:
                    yield shard()
                    ids, lengths, numbers, times, points = [], [], [], [], 0
        if ids:
            yield shard()

    found = rows.where(F.octet_length("terms") > 0)
    return map_stream(found.select("doc_id", "n", "terms", "times"), build, INDEX)


def search_index(index: DataFrame, items: Items, order: np.ndarray, weight: np.ndarray,
                 top: int = TOP) -> DataFrame:
    """(item, doc_id, score): of each task, the best ``top`` documents of each item."""
    queries = [(order[rows], weight[rows]) for rows in items.rows]

    def search(batches):
        best = [Best(top) for _ in queries]
        for batch in batches:
            for ids, depth, stretch, quarters, largest in zip(
                    *[c.to_pylist() for c in batch.columns], strict=True):
                treap = Treap.unpacked(depth, stretch, quarters, largest)
                for (rows, value), found in zip(queries, best, strict=True):
                    if len(rows):
                        descend(treap, rows, value, ids, found)
        hits = [(n, None if absent else doc, -score) for n, b in enumerate(best)
                for score, absent, doc in b.found]
        yield {name: [h[i] for h in hits] for i, name in enumerate(("item", "doc_id", "score"))}

    return map_stream(index, search, "item long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP,
           item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` highest scores of every item."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    parts = [spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")]
    for block in item_blocks(items, item_bytes):
        if not len(block.terms):
            continue
        rows = stored(postings(docs, block.terms), "postings")
        documents, terms, held = statistics(rows, len(block.terms))
        if not terms:
            continue
        order = np.empty(len(held), np.int64)
        order[np.lexsort((np.arange(len(held)), held))] = np.arange(len(held))
        index = build_index(rows, order, documents, terms)
        found = search_index(index, block, order, weights(documents, held), top)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item long, item_id {kind}")
        parts.append(found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(),
                                                 F.col("doc_id").asc_nulls_last())
    return (every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score"))


def op13_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(id_and_text(table(spark, sf_dir, "documents")),
                  table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
total AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark WHERE item_id IS NOT NULL),
tf AS (
  SELECT r, doc_id, n, t, count(*) AS f
  FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY r, doc_id, n, t),
w AS (
  SELECT t, CAST(floor(1000 * ln((2 * total.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))
                 AS BIGINT) AS w
  FROM tf, total GROUP BY t, total.n),
s AS (
  SELECT item_id, doc_id, r,
         CAST(sum(w * ((1000000000 * f) // (1000 * f + 8 * (10 + (90 * tf.n * total.n) // total.l))))
              AS BIGINT) AS score
  FROM q JOIN tf ON q.t = tf.t JOIN w ON w.t = q.t, total GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id
                               ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM s WHERE score > 0) WHERE rank <= 10
"""
