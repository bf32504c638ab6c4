"""Frame of the two repeated-string operators: anchors, segments, and removal.

A window is ``window`` consecutive units (words or bytes) of one document. Its anchor is the
smallest hash of the ``gram``-unit strings in it, so equal windows have equal anchors,
wherever they stand. Windows whose anchor stands at one place of the whole corpus only cannot
be repeated; the rest lie in segments, runs of windows with one anchor. Segments of an
anchor meet in one task, where the operator's index says which windows are repeated there.

An anchor that stands in more than ``HOT`` places (a passage that many documents share, a run of
one word) is told apart further: its windows lie in segments of a second anchor, the smallest
gram by another hash. Such segments are counted before they meet, so copies are one text, and
go to the same index. Only where the different texts of a second anchor exceed a shard are
windows counted by their hash instead, once a text, so no task holds such a group.

Texts are shuffled twice at most: to meet their repeated anchors, and, only if they have some,
to be cut. What is found travels as spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    _BYTE_VALUE,
    Words,
    binary_column,
    byte_blocks,
    list_column,
    map_arrow,
    mix,
    prefix_sums,
    row_key,
    run_hashes,
    signed,
    stored,
)

HOT = 400
_SECOND = np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Unit:
    """What windows are made of: words or bytes."""

    words: bool
    window: int
    gram: int

    def read(self, block: np.ndarray, offsets: np.ndarray):
        """(value of each unit, first unit of each document, byte bounds of the units)."""
        if not self.words:
            return _BYTE_VALUE[block], offsets, np.arange(len(block)), np.arange(1, len(block) + 1)
        found = Words(block, offsets)
        return found.hashes(), found.first, found.starts, found.ends

    def digest(self, text: bytes) -> str:
        return hashlib.sha256(b" ".join(text.split()) if self.words else text).hexdigest()


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least or largest of each run of ``width`` values, by doubling."""
    size, out = 1, values
    while size < width:
        step = min(size, width - size)
        out = pick(out[:-step], out[step:])
        size += step
    return out


def window_anchors(unit: Unit, values: np.ndarray, first: np.ndarray):
    """(anchor of each window, whether the window lies in one document, gram hashes)."""
    count = len(values) - unit.window + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64), None
    sums = prefix_sums(values)
    at = np.arange(len(values) - unit.gram + 1)
    grams = run_hashes(sums, at, at + unit.gram)
    anchors = sliding(grams, unit.window - unit.gram + 1, np.minimum)
    whole = np.zeros(count, bool)
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= unit.window:
            whole[low:high - unit.window + 1] = True
    return anchors, whole, grams, sums


def anchor_places(unit: Unit, anchors: np.ndarray, whole: np.ndarray, grams: np.ndarray):
    """Places of grams that are the anchor of a window around them."""
    span = unit.window - unit.gram
    padded = np.zeros(len(anchors) + 2 * span, np.uint64)
    padded[span:span + len(anchors)] = np.where(whole, anchors, 0)
    best = sliding(padded, span + 1, np.maximum)
    return np.flatnonzero(best[:len(grams)] == grams)


def describe(docs: DataFrame, unit: Unit) -> DataFrame:
    """(doc_id, k_id, k_tx, n_units, sha, anchors, places) of every row."""

    def run(batch):
        rows = batch.num_rows
        units, sha = np.zeros(rows, np.int64), [None] * rows
        lists = [np.zeros(0, np.uint64)] * rows
        counts = [np.zeros(0, np.int32)] * rows
        for low, high, block, offsets in byte_blocks(batch["text"]):
            values, first, _, _ = unit.read(block, offsets)
            anchors, whole, grams, _ = window_anchors(unit, values, first)
            places = (anchor_places(unit, anchors, whole, grams) if len(anchors)
                      else np.zeros(0, np.int64))
            bounds = np.searchsorted(places, first)
            units[low:high] = np.diff(first)
            data = block.tobytes()
            for i in range(high - low):
                sha[low + i] = unit.digest(data[offsets[i]:offsets[i + 1]])
                own = grams[places[bounds[i]:bounds[i + 1]]]
                if len(own):
                    lists[low + i], counts[low + i] = np.unique(own, return_counts=True)
        sizes = [len(x) for x in lists]
        yield {"doc_id": batch["doc_id"], "k_id": batch["k_id"], "k_tx": batch["k_tx"],
               "n_units": units, "sha": sha,
               "anchors": list_column(signed(np.concatenate(lists)) if rows else [], sizes),
               "places": list_column(np.concatenate(counts).astype(np.int32) if rows else [],
                                     sizes)}

    return map_arrow(docs.select("doc_id", *row_key(), "text"), run,
                     "doc_id long, k_id long, k_tx long, n_units long, sha string, "
                     "anchors array<long>, places array<int>")


def repeated_anchors(described: DataFrame) -> DataFrame:
    """(k_id, k_tx, anchors): repeated anchors of the documents that have some; hot ones apart."""
    flat = described.select("k_id", "k_tx", F.explode(F.arrays_zip("anchors", "places")).alias("x"))
    flat = flat.select("k_id", "k_tx", F.col("x.anchors").alias("anchor"), "x.places")
    counts = (flat.groupBy("anchor").agg(F.sum("places").alias("n")).where("n > 1")
              .select("anchor", (F.col("n") > HOT).alias("hot")))
    held = flat.select("k_id", "k_tx", "anchor").join(counts, "anchor").distinct()
    return held.groupBy("k_id", "k_tx").agg(
        F.collect_list(F.when(~F.col("hot"), F.col("anchor"))).alias("anchors"),
        F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))


def second_anchors(unit: Unit, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grams by another hash, the smallest of them in each window)."""
    other = mix(grams ^ _SECOND)
    return other, sliding(other, unit.window - unit.gram + 1, np.minimum)


def segments(held: DataFrame, unit: Unit) -> DataFrame:
    """(anchor, k_id, k_tx, first, data, units, places): segments with their bytes.

    Those of hot anchors are cut by their second anchor too; ``anchor`` is both in one, and
    ``places`` (else NULL) how often the second stands in the segment.
    """

    def run(batch):
        keys = [batch["k_id"].to_pylist(), batch["k_tx"].to_pylist()]
        for low, high, block, offsets in byte_blocks(batch["text"]):
            values, first, starts, ends = unit.read(block, offsets)
            anchors, whole, grams, _ = window_anchors(unit, values, first)
            names = ("anchor", "k_id", "k_tx", "first", "data", "units", "places")
            out, second = {n: [] for n in names}, None

            def add(row, anchor, at, x, y, places):
                length = y - x + unit.window - 1
                data = block[starts[at + x]:ends[at + x + length - 1]]
                for n, v in zip(names, (anchor, keys[0][row], keys[1][row], x, data, length,
                                        places), strict=True):
                    out[n].append(v)

            for i in range(high - low):
                a, b = int(first[i]), int(first[i + 1]) - unit.window + 1
                if b <= a:
                    continue
                own = anchors[a:b]
                wanted = np.array(batch["anchors"][low + i].as_py(), np.int64).view(np.uint64)
                cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                stop = np.append(cut[1:], len(own))
                take = np.isin(own[cut], wanted)
                for x, y in zip(cut[take].tolist(), stop[take].tolist(), strict=True):
                    add(low + i, own[x], a, x, y, None)
                hot = np.array(batch["hot"][low + i].as_py(), np.int64).view(np.uint64)
                if not len(hot):
                    continue
                if second is None:
                    other, second = second_anchors(unit, grams)
                mine = second[a:b]
                cut = np.flatnonzero(np.append(True, (own[1:] != own[:-1])
                                               | (mine[1:] != mine[:-1])))
                stop = np.append(cut[1:], len(own))
                take = np.isin(own[cut], hot)
                both = mix(own[cut] + mix(mine[cut]))
                for x, y, key in zip(cut[take].tolist(), stop[take].tolist(), both[take],
                                     strict=True):
                    inside = other[a + x:a + y + unit.window - unit.gram]
                    add(low + i, key, a, x, y, int(np.count_nonzero(inside == mine[x])))
            if out["first"]:
                out["anchor"] = signed(np.array(out["anchor"], np.uint64))
                out["data"] = binary_column(out["data"])
                yield out

    return map_arrow(held, run, "anchor long, k_id long, k_tx long, first long, data binary, "
                                "units long, places long")


def unions(windows: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """Lows and highs of the stretches that the windows cover; windows are in order."""
    gap = np.flatnonzero(np.diff(windows) > window)
    return (windows[np.append(0, gap + 1)].tolist(),
            (windows[np.append(gap, len(windows) - 1)] + window).tolist())


Matcher = Callable[[list[np.ndarray]], Iterator[tuple[int, np.ndarray]]]


def matched(rows: DataFrame, unit: Unit, matcher: Matcher, shard: int,
            parts: int | None = None) -> DataFrame:
    """(k_id, k_tx, low, high) of repeated windows' unions, relative to the document.

    ``matcher`` gets distinct segments, and gives for each the windows (by their first unit)
    that stand somewhere else among them; segments that stand twice are repeated in whole.
    A task cuts its anchors into shards of about ``shard`` bytes, never within an anchor.
    With ``parts`` there are so many tasks, however few the bytes.
    """
    names = ["k_id", "k_tx", "low", "high"]

    def solve(held):
        index: dict[tuple[int, bytes], list[int]] = {}
        for i, (anchor, _, _, _, data) in enumerate(held):
            index.setdefault((anchor, data), []).append(i)
        texts = list(index)
        sizes = [np.frombuffer(d, np.uint8) for _, d in texts]
        out = {n: [] for n in names}

        def add(members, low, high):
            for m in members:
                _, k_id, k_tx, first, _ = held[m]
                for n, v in zip(names, (k_id, k_tx, first + low, first + high), strict=True):
                    out[n].append(v)

        for at, windows in matcher(sizes):
            members = index[texts[at]]
            if len(windows):
                for low, high in zip(*unions(windows, unit.window), strict=True):
                    add(members, low, high)
        for key, members in index.items():
            if len(members) > 1:
                add(members, 0, unit_count(unit, key[1]))
        return pa.record_batch([pa.array(out[n], pa.int64()) for n in names], names=names)

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            columns = (batch["anchor"].to_pylist(), batch["k_id"].to_pylist(),
                       batch["k_tx"].to_pylist(), batch["first"].to_pylist(),
                       batch["data"].to_pylist())
            for row in zip(*columns, strict=True):
                if row[0] != last and size >= shard:
                    yield solve(held)
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    dealt = (rows.select("anchor", "k_id", "k_tx", "first", "data")
             .repartition(*[parts] * (parts is not None), "anchor").sortWithinPartitions("anchor"))
    return dealt.mapInArrow(run, "k_id long, k_tx long, low long, high long")


def unit_count(unit: Unit, data: bytes) -> int:
    return len(data.split()) if unit.words else len(data)


def counted(texts: DataFrame, unit: Unit) -> DataFrame:
    """(anchor, text, low, high) of repeated windows' unions in different texts, by hash.

    A window's hash is 64 bits beside the 64 of its anchors. It is one row a text, however
    often it stands there.
    """

    def windows(batch):
        anchors, names = batch["anchor"].to_pylist(), batch["text"].to_pylist()
        for low, high, block, offsets in byte_blocks(batch["data"]):
            values, first, _, _ = unit.read(block, offsets)
            sums = prefix_sums(values)
            for i in range(high - low):
                at = np.arange(first[i], first[i + 1] - unit.window + 1)
                hashes = run_hashes(sums, at, at + unit.window)
                order = np.argsort(hashes, kind="stable")
                found, sizes = np.unique(hashes, return_counts=True)
                yield {"anchor": [anchors[low + i]] * len(found),
                       "text": [names[low + i]] * len(found), "window": signed(found),
                       "lows": list_column(order.astype(np.int32), sizes)}

    def spans(batch):
        out = {n: [] for n in ("anchor", "text", "low", "high")}
        for anchor, text, lows in zip(batch["anchor"].to_pylist(), batch["text"].to_pylist(),
                                      batch["lows"], strict=True):
            for low, high in zip(*unions(np.sort(np.array(lows.as_py(), np.int64)), unit.window),
                                 strict=True):
                for n, v in zip(out, (anchor, text, low, high), strict=True):
                    out[n].append(v)
        yield out

    single = map_arrow(texts.select("anchor", "text", "data"), windows,
                       "anchor long, text long, window long, lows array<int>")
    repeated = (single.groupBy("anchor", "window").agg(F.sum(F.size("lows")).alias("n"))
                .where("n > 1").select("anchor", "window"))
    held = single.join(repeated, ["anchor", "window"]).groupBy("anchor", "text").agg(
        F.flatten(F.collect_list("lows")).alias("lows"))
    return map_arrow(held, spans, "anchor long, text long, low long, high long")


def matched_hot(rows: DataFrame, unit: Unit, matcher: Matcher, shard: int) -> DataFrame:
    """(k_id, k_tx, low, high) of repeated windows' unions in segments of hot anchors.

    Equal segments are one text. Texts that share both anchors meet in ``matched``, or,
    where they hold more than ``shard`` bytes, in ``counted``.
    """
    texts = rows.groupBy("anchor", "data").agg(
        F.count("*").alias("n"), F.max("units").alias("units"), F.max("places").alias("places"))
    keys = (texts.groupBy("anchor")
            .agg(F.sum("n").alias("held"), F.max("places").alias("places"),
                 F.sum(F.length("data")).alias("bytes"))
            .where("held > 1 or places > 1")
            .select("anchor", (F.col("bytes") > shard).alias("many")))
    texts = stored(texts.drop("places").join(keys, "anchor")
                   .withColumn("text", F.xxhash64("data")), "repeathot")
    few = matched(texts.where("not many").select(
        "anchor", F.col("anchor").alias("k_id"), F.col("text").alias("k_tx"),
        F.lit(0).cast("long").alias("first"), "data"), unit, matcher, shard,
        int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    copies = texts.where("n > 1").select("anchor", "text", F.lit(0).cast("long").alias("low"),
                                         F.col("units").alias("high"))
    found = (few.toDF("anchor", "text", "low", "high").unionByName(copies)
             .unionByName(counted(texts.where("many"), unit)))
    members = rows.select("anchor", F.xxhash64("data").alias("text"), "k_id", "k_tx", "first")
    return members.join(found, ["anchor", "text"]).select(
        "k_id", "k_tx", (F.col("first") + F.col("low")).alias("low"),
        (F.col("first") + F.col("high")).alias("high"))


def removed(docs: DataFrame, unit: Unit, matcher: Matcher, shard: int, keep_text: bool = False):
    """doc_id, n_units, n_removed, n_spans, sha256 of what is kept, and k_id, k_tx of every row.

    With ``keep_text`` the kept text itself is added.
    """
    described = stored(describe(docs, unit), "repeatrows")
    anchors = repeated_anchors(described)
    texts = docs.select(*row_key(), F.col("text").cast("binary").alias("text"))
    held = stored(texts.join(anchors, ["k_id", "k_tx"]), "repeattexts")
    rows = stored(segments(held, unit), "repeatsegments")
    spans = matched(rows.where("places is null"), unit, matcher, shard).unionByName(
        matched_hot(rows.where("places is not null"), unit, matcher, shard))
    lists = spans.groupBy("k_id", "k_tx").agg(F.collect_list("low").alias("low"),
                                              F.collect_list("high").alias("high"))

    def cut(batch):
        n_removed, n_spans, sha, kept = [], [], [], []
        for text, low, high in zip(batch["text"], batch["low"], batch["high"], strict=True):
            text = text.as_py()
            parts = text.split() if unit.words else text
            edge = np.zeros(len(parts) + 1, np.int64)
            np.add.at(edge, np.array(low.as_py()), 1)
            np.add.at(edge, np.array(high.as_py()), -1)
            gone = np.cumsum(edge)[:-1] > 0
            n_removed.append(int(gone.sum()))
            n_spans.append(int(np.count_nonzero(np.diff(np.append(0, gone.view(np.int8))) == 1)))
            stay = np.flatnonzero(~gone)
            left = (b" ".join([parts[i] for i in stay.tolist()]) if unit.words
                    else np.frombuffer(text, np.uint8)[stay].tobytes())
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        out = {"k_id": batch["k_id"], "k_tx": batch["k_tx"], "n_removed": n_removed,
               "n_spans": n_spans, "sha_kept": sha}
        yield out | ({"kept": kept} if keep_text else {})

    schema = "k_id long, k_tx long, n_removed long, n_spans long, sha_kept string"
    changed = map_arrow(held.select("k_id", "k_tx", "text").join(lists, ["k_id", "k_tx"]), cut,
                        schema + (", kept binary" if keep_text else ""))
    changed = changed.dropDuplicates(["k_id", "k_tx"])  # rows that repeat are alike
    joined = described.drop("anchors", "places").join(changed, ["k_id", "k_tx"], "left")
    more = ["kept"] if keep_text else []
    return joined.select("doc_id", "k_id", "k_tx", "n_units",
                         F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
                         F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
                         F.coalesce("sha_kept", "sha").alias("kept_sha256"), *more)
