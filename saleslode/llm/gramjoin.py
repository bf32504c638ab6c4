"""N-gram Jaccard join with parity sketches: which documents share nearly all shingles.

A document is the set of its distinct word shingles. Two sets link when
``100 * |A & B| >= threshold * |A | B|``, which bounds their symmetric difference by
``(100 - t) * (|A| + |B|) / (100 + t)``. Shingles are XOR-ed into a bit sketch; each
shingle flips one bit, so the Hamming distance of two sketches never exceeds the symmetric
difference. Sketches of a size band (sizes up to a power of two) have about a third more
words than the largest difference allowed in it, so linked sets agree on some words: words
are the join keys. A word is very wide and has few bits set, so it is held as the XOR of a
64-bit hash of each bit; different words agree by chance only once in 2**64. A set near the upper end of its band is sketched for the next band
too. Words with no or one bit are shared by chance, above all where shingles are common. A
set leaves them out as long as they are fewer than the words it must share with any
partner; as shared words are equally poor in both sets, some shared word stays.

Equal sets are one candidate from the start (64-bit digest; a wrong merge needs two
different sets among 2**32). Of the words that a set shares with any other it must share a
known number with a linked set. So join keys are the rarest of them, all but that number less
``MEET``, and a linked pair meets in ``MEET`` of them (or in as many as it must share). Sets
with fewer shared words have no link. Sets that share a key make a group. Groups up to
``SMALL`` give all their pairs; a larger one only pairs its members with its smallest. Pairs
that meet often enough are verified exactly on the shingle sets. Large groups that share
members form a family; families are cut into tiles of at most about ``TILE`` sets or
``TILE_BYTES`` a side, and each pair of a family lies in one tile, where it is compared exactly
if its sizes and fixed-length sketches are near enough. So every link is counted once: in its
tile, or among the pairs of small groups if it lies in no family. A family costs the square of
its different sets, as it may hold that many links (equal texts are one set and cost nothing);
a tile hands on its counts and the links that join its components, not all its pairs.

Edge cases: NULL, empty and blank texts have no shingle, link with nothing and are their own
component; fewer words than a shingle make one shingle; repeated rows share a component;
rows with a NULL id get their own component number, NULL, unless linked; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import (
    LOWER,
    NO_ID,
    Words,
    binary_column,
    byte_blocks,
    gram_hashes,
    id_and_text,
    kept,
    map_arrow,
    mix,
    packed_rows,
    row_key,
    signed,
    stored,
    table,
)
from .graph import connected_components

WORDS, THRESHOLD = 4, 85
SMALL = 10
HUGE = 1024
FLUSH = 100_000  # keys that a task holds before it hands them on
MEET = 4
TILE = 2048
TILE_BYTES = 1 << 23
TILE_WORDS = 64
_U = np.uint64


def shingle_sets(column: pa.Array, size: int):
    """(row, sorted distinct shingle hashes) of each text of a batch, empty sets included."""
    for first, _, block, offsets in byte_blocks(column):
        words = Words(LOWER[block], offsets)
        hashes = words.hashes()
        grams = gram_hashes(hashes, size)
        bounds = words.first.tolist()
        for i in range(len(offsets) - 1):
            low, high = bounds[i], bounds[i + 1]
            if high - low >= size:
                yield first + i, np.unique(grams[low:high - size + 1])
            else:
                yield first + i, gram_hashes(hashes[low:high], max(1, high - low))


def set_digest(shingles: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = mix(shingles ^ _U(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    return int(signed(mix(np.array([total + _U(len(shingles))], np.uint64)))[0])


def bands(size: int, threshold: int) -> list[tuple[int, int, int]]:
    """(band, words of its sketch, largest difference of a linked pair) for a set size."""
    found = []
    band = size.bit_length() - 1
    if not size:
        return found
    for b in (band, band + 1):
        largest = (2 << b) - 1
        if b > band and 100 * size // threshold <= largest // 2:
            continue
        widest = (100 - threshold) * 2 * largest // (100 + threshold)
        words = widest + 1 + max(1, widest // 3)
        partner = min(100 * size // threshold, largest)
        if widest:
            found.append((b, words, (100 - threshold) * (size + partner) // (100 + threshold)))
    return found


def sketch(shingles: np.ndarray, words: int, seed: int) -> np.ndarray:
    """Parity sketch of ``words`` 64-bit words, to bound distances within a tile."""
    place = mix(shingles ^ _U(seed)) % _U(64 * words)
    parity = (np.bincount(place.astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.uint64)


def wide_sketch(shingles: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(content, bits set) of each word of a parity sketch of ``words`` wide words."""
    place = (mix(shingles ^ _U(1)) % _U(words)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    first = np.flatnonzero(np.diff(place[order], prepend=-1))
    content = np.zeros(words, np.uint64)
    bits = mix(shingles ^ _U(0x8CB92BA72F3D8DD7))[order]
    content[place[order[first]]] = np.bitwise_xor.reduceat(bits, first)
    return content, np.bincount(place, minlength=words)


def poorest(bits: np.ndarray, difference: int) -> int:
    """Number of bits up to which words are left out: one, none, or no word at all (-1)."""
    shared = len(bits) - difference
    none, one = np.bincount(np.minimum(bits, 2), minlength=3)[:2].tolist()
    return 1 if none + one <= 2 * shared // 3 else 0 if none < shared else -1


def word_keys(shingles: np.ndarray, threshold: int) -> np.ndarray:
    """Join keys of a set: band (last six bits), place and content of its sketch words."""
    keys = []
    for band, words, difference in bands(len(shingles), threshold):
        content, bits = wide_sketch(shingles, words)
        place = np.arange(words, dtype=np.uint64) | _U(band << 40)
        rich = bits > poorest(bits, difference)
        keys.append(mix(content[rich] ^ mix(place[rich])) & ~_U(63) | _U(band))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def poor_words(shingles: np.ndarray, threshold: int) -> list[int]:
    """Words with at most one bit in the sketches of the set's own band and of the next."""
    own = len(shingles).bit_length() - 1
    counts = [0, 0]
    for band, words, _ in bands(len(shingles), threshold):
        counts[band - own] = int((wide_sketch(shingles, words)[1] < 2).sum())
    return counts


def describe_sets(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """(doc_id, k_id, k_tx, n_shingles, own, bare, bare_next, set_id) of every row.

    ``own`` is the set's band, the next two count words of at most one bit in its sketches.
    """
    rows = docs.select("doc_id", *row_key(), "text")

    def run(batch):
        count, digest = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        bare = np.zeros((batch.num_rows, 3), np.int64)
        for row, shingles in shingle_sets(batch["text"], words):
            count[row] = len(shingles)
            digest[row] = set_digest(shingles)
            bare[row] = [len(shingles).bit_length() - 1, *poor_words(shingles, threshold)]
        yield {"doc_id": batch["doc_id"], "k_id": batch["k_id"], "k_tx": batch["k_tx"],
               "n_shingles": count, "own": bare[:, 0], "bare": bare[:, 1],
               "bare_next": bare[:, 2], "set_id": pa.array(digest, mask=count == 0)}

    return map_arrow(rows, run, "doc_id long, k_id long, k_tx long, n_shingles long, "
                                "own long, bare long, bare_next long, set_id long")


def sketch_words(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """(key, set_id); equal sets of a batch give their keys once."""

    def run(batch):
        seen, keys, ids, size = set(), [], [], 0
        for _, shingles in shingle_sets(batch["text"], words):
            if not len(shingles):
                continue
            digest = set_digest(shingles)
            if digest in seen:
                continue
            seen.add(digest)
            own = word_keys(shingles, threshold)
            keys.append(own)
            ids.append(np.full(len(own), digest, np.int64))
            size += len(own)
            if size >= FLUSH:
                yield {"key": signed(np.concatenate(keys)), "set_id": np.concatenate(ids)}
                keys, ids, size = [], [], 0
        if keys:
            yield {"key": signed(np.concatenate(keys)), "set_id": np.concatenate(ids)}

    return map_arrow(docs.select("text"), run, "key long, set_id long")


def group_pairs(keyed: DataFrame) -> DataFrame:
    """(a, b, key, large): all pairs of small groups, smallest and other members of large ones."""
    schema = "a long, b long, key long, large boolean"

    def run(batches):
        tail_key, tail_set = np.zeros(0, np.int64), np.zeros(0, np.int64)
        leader = None  # (key, smallest set) of a large group that is still open

        def emit(key, ids):
            nonlocal leader
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
            key, ids = key[fresh], ids[fresh]
            parts = []
            if leader is not None and len(key):
                own = key == leader[0]
                if own.any():
                    member = ids[own & (ids != leader[1])]
                    parts.append((np.full(len(member), leader[1]), member,
                                  np.full(len(member), leader[0]), True))
                    key, ids = key[~own], ids[~own]
            if len(key):
                start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                size = np.diff(np.append(start, len(key)))
                of = np.repeat(np.arange(len(start)), size)
                big = (size > SMALL)[of]
                for step in range(1, min(SMALL, len(key))):
                    both = (key[step:] == key[:-step]) & ~big[:-step]
                    if not both.any():
                        break
                    parts.append((ids[:-step][both], ids[step:][both], key[step:][both], False))
                rest = np.flatnonzero(big)
                rest = rest[rest != start[of[rest]]]
                if len(rest):
                    parts.append((ids[start[of[rest]]], ids[rest], key[rest], True))
            for a, b, k, many in parts:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                       pa.array(k, pa.int64()), pa.array([many] * len(a), pa.bool_())],
                                      names=["a", "b", "key", "large"])

        for batch in batches:
            key = np.concatenate([tail_key, batch["key"].to_numpy()])
            ids = np.concatenate([tail_set, batch["set_id"].to_numpy()])
            if not len(key):
                continue
            open_from = int(np.searchsorted(key, key[-1]))
            yield from emit(key[:open_from], ids[:open_from])
            last, members = key[-1], ids[open_from:]
            if leader is not None and leader[0] != last:
                leader = None
            if leader is None and len(np.unique(members)) > SMALL:
                yield from emit(np.full(len(members), last), members)
                leader = (last, members[0])
                members = members[:0]
            elif leader is not None:
                yield from emit(np.full(len(members), last), members)
                members = members[:0]
            tail_key, tail_set = np.full(len(members), last), members
        yield from emit(tail_key, tail_set)

    sorted_rows = keyed.repartition("key").sortWithinPartitions("key", "set_id")
    return sorted_rows.mapInArrow(run, schema)


def load_sets(docs: DataFrame, described: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(set_id, shingles) of the wanted sets, from one document of each."""
    holder = (described.join(wanted, "set_id").groupBy("set_id")
              .agg(F.min(F.struct("k_id", "k_tx")).alias("k")).select("set_id", "k.*"))
    rows = (docs.select(*row_key(), "text").join(holder, ["k_id", "k_tx"])
            .dropDuplicates(["k_id", "k_tx"]).select("set_id", "text"))

    def run(batch):
        chunks = [s for _, s in shingle_sets(batch["text"], words)]
        yield {"set_id": batch["set_id"], "shingles": binary_column(chunks)}

    return map_arrow(rows, run, "set_id long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose sets reach the threshold."""
    left = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("y"))
    size = F.octet_length
    joined = pairs.join(left, "a").join(right, "b").where(
        100 * F.least(size("x"), size("y")) >= threshold * F.greatest(size("x"), size("y")))

    def run(batch):
        keep = []
        for x, y in zip(batch["x"], batch["y"], strict=True):
            x, y = (packed_rows(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(100 * both >= threshold * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        yield {"a": batch["a"].filter(mask), "b": batch["b"].filter(mask)}

    return map_arrow(joined.select("a", "b", "x", "y"), run, "a long, b long")


def band_words(threshold: int) -> str:
    """SQL for the words of a band's sketch, as in ``bands``."""
    widest = f"({100 - threshold} * 2 * (shiftleft(2L, band) - 1) div {100 + threshold})"
    return f"({widest} + 1 + greatest(1, {widest} div 3))"


def repeated_words(keyed: DataFrame) -> DataFrame:
    """(key, set_id, size) of the words that two sets or more share; ``HUGE`` is any size above."""

    def run(batches):
        names = ["key", "set_id", "size"]
        tail_key, tail_set, huge = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def emit(key, ids, known=None):
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
            key, ids = key[fresh], ids[fresh]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else []
            size = np.repeat(np.diff(np.append(start, len(key))), np.diff(np.append(start, len(key))))
            size = np.full(len(key), known) if known else np.minimum(size, HUGE)
            some = size > 1
            yield pa.record_batch([pa.array(key[some]), pa.array(ids[some]),
                                   pa.array(size[some].astype(np.int64))], names=names)

        for batch in batches:
            key = np.concatenate([tail_key, batch["key"].to_numpy()])
            ids = np.concatenate([tail_set, batch["set_id"].to_numpy()])
            if huge is not None and len(key):
                own = int(np.searchsorted(key, huge, "right"))
                yield from emit(key[:own], ids[:own], HUGE)
                key, ids = key[own:], ids[own:]
            if not len(key):
                tail_key, tail_set = key, ids
                continue
            huge = None
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from emit(key[:cut], ids[:cut])
            tail_key, tail_set = key[cut:], ids[cut:]
            if len(np.unique(tail_set)) >= HUGE:
                huge = tail_key[0]
                yield from emit(tail_key, tail_set, HUGE)
                tail_key, tail_set = tail_key[:0], tail_set[:0]
        if len(tail_key):
            yield from emit(tail_key, tail_set)

    sorted_rows = keyed.repartition("key").sortWithinPartitions("key", "set_id")
    return sorted_rows.mapInArrow(run, "key long, set_id long, size long")


def shared_words_needed(described: DataFrame, threshold: int) -> DataFrame:
    """(set_id, band, needed): words that a set of the band shares with any it links to."""
    sizes = described.where("set_id is not null").groupBy("set_id").agg(
        F.max("n_shingles").alias("n"), *(F.max(c).alias(c) for c in ("own", "bare", "bare_next")))
    banded = sizes.withColumn("band", F.explode(F.array(F.col("own").cast("int"), (F.col("own") + 1).cast("int"))))
    partner = f"least(100 * n div {threshold}, shiftleft(2L, band) - 1)"
    most = f"({100 - threshold} * (n + {partner}) div {100 + threshold})"
    return banded.select("set_id", "band", F.expr(
        f"greatest(1, {band_words(threshold)} - {most} - if(band = own, bare, bare_next))")
        .alias("needed"))


def rarest_words(repeated: DataFrame, needed: DataFrame) -> DataFrame:
    """(key, set_id): of each set's repeated words, the rarest that a link must touch."""
    of = Window.partitionBy("set_id", "band")
    banded = repeated.withColumn("band", F.col("key").bitwiseAND(63).cast("int"))
    meet = F.least("needed", F.lit(MEET))
    return (banded.withColumn("held", F.count("*").over(of))
            .withColumn("place", F.row_number().over(of.orderBy("size", "key")))
            .join(needed, ["set_id", "band"]).where(F.col("held") >= F.col("needed"))
            .where(F.col("place") <= F.col("held") - F.col("needed") + meet)
            .select("key", "set_id"))


def meeting_pairs(grouped: DataFrame, needed: DataFrame) -> DataFrame:
    """(a, b) of the pairs that meet in ``MEET`` groups, or in as many as either must share."""
    met = grouped.groupBy("a", "b", F.col("key").bitwiseAND(63).cast("int").alias("band")).agg(
        F.count("*").alias("met"))
    few = needed.where(F.col("needed") < MEET)
    rare = met.where(F.col("met") < MEET)
    by_either = [rare.join(few.withColumnRenamed("set_id", side), [side, "band"])
                 .where("met >= needed").select("a", "b") for side in ("a", "b")]
    often = met.where(F.col("met") >= MEET).select("a", "b")
    return often.unionByName(by_either[0]).unionByName(by_either[1]).distinct()


def link_sets(docs: DataFrame, described: DataFrame, words: int,
              threshold: int) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between set ids, enough of them to give all components, and
    (set_id, n_links), the number of all verified links of each linked set."""
    repeated = repeated_words(sketch_words(docs, words, threshold))
    needed = shared_words_needed(described, threshold)
    grouped = stored(group_pairs(rarest_words(repeated, needed)), "grampairs")
    pairs = kept(meeting_pairs(grouped, needed))
    large = grouped.where("large")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).unionByName(
        large.select(F.explode(F.array("a", "b")).alias("set_id"))).distinct()
    sets = stored(load_sets(docs, described, wanted, words), "gramsets")
    links = kept(verified(pairs, sets, threshold))
    counted = links
    found = []
    if not large.isEmpty():
        family = kept(connected_components(large)).select(F.col("node").alias("set_id"),
                                                          F.col("root").alias("family"))
        met = kept(family_links(family, sets, threshold))
        for side in ("a", "b"):
            counted = counted.join(family.select(F.col("set_id").alias(side), F.col("family")
                                                 .alias(f"of_{side}")), side, "left")
        counted = counted.where("of_a is null or of_b is null or of_a != of_b")
        found.append(met.where("b is null").select(F.col("a").alias("set_id"), "n"))
        links = links.unionByName(met.where("b is not null").select("a", "b"))
    found.append(counted.select(F.explode(F.array("a", "b")).alias("set_id"),
                                F.lit(1).cast("long").alias("n")))
    degrees = reduce(DataFrame.unionByName, found).groupBy("set_id").agg(
        F.sum("n").alias("n_links"))
    return links, degrees


def family_links(family: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links within families: (a, b, NULL) to join components and (a, NULL, n) to count.

    ``family`` has set_id and family. Each pair of a family is compared in one tile; a tile
    gives a row for each of its sets with links, and of its links only those that join sets
    that no other link of the tile joins.
    """
    rows = family.join(sets.select("set_id", F.octet_length("shingles").alias("size")), "set_id")
    sizes = rows.groupBy("family").agg(F.ceil(F.greatest(
        F.count("*") / F.lit(TILE), F.sum("size") / F.lit(TILE_BYTES))).cast("int").alias("chunks"))
    placed = rows.join(sizes, "family").withColumn(
        "chunk", F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int"))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "family", "set_id", "chunk", F.least("chunk", "other").alias("i"),
        F.greatest("chunk", "other").alias("j"))

    def compare(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        ids, chunk = tile["set_id"].to_numpy(), tile["chunk"].to_numpy()
        held = [packed_rows(v.as_buffer(), np.uint64) for v in tile["shingles"]]
        low, high = tile["i"][0].as_py(), tile["j"][0].as_py()
        size = np.array([len(s) for s in held])
        order = np.argsort(size, kind="stable")
        sides = [order[chunk[order] == c] for c in (low, high)]
        bits = np.stack([sketch(s, TILE_WORDS, 2) for s in held])
        a, b, degree = compare_sides(held, size, bits, *sides, low == high, threshold)
        some = np.flatnonzero(degree)
        return pa.table({
            "a": pa.array(np.concatenate([ids[a], ids[some]]), pa.int64()),
            "b": pa.array(ids[b].tolist() + [None] * len(some), pa.int64()),
            "n": pa.array([None] * len(a) + degree[some].tolist(), pa.int64())})

    return tiles.join(sets, "set_id").groupBy("family", "i", "j").applyInArrow(
        compare, "a long, b long, n long")


def compare_sides(held: list[np.ndarray], size: np.ndarray, bits: np.ndarray, left: np.ndarray,
                  right: np.ndarray, same: bool, threshold: int):
    """(a, b, degree): joining links between two lists of sets, and the links of every set.

    Both lists are in order of size; if they are the ``same``, each pair is taken once.
    """
    parent = np.arange(len(held))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    # Shingles as small numbers, those of the right side in one run.
    coded = np.unique(np.concatenate(held), return_inverse=True)[1].astype(np.int32)
    ends = np.cumsum(size)
    codes = [coded[e - n:e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(held), np.int64)
    run = np.concatenate([codes[y] for y in right.tolist()])
    start = np.concatenate([[0], np.cumsum(size[right])])
    right_size, right_bits = size[right], bits[right]
    mark = np.zeros(int(coded.max()) + 1, np.int32)
    degree = np.zeros(len(held), np.int64)
    a, b = [], []
    for at, x in enumerate(left.tolist()):
        first = at + 1 if same else int(np.searchsorted(
            right_size, -(-threshold * int(size[x]) // 100)))
        last = int(np.searchsorted(right_size, 100 * int(size[x]) // threshold, "right"))
        if first >= last:
            continue
        total = size[x] + right_size[first:last]
        apart_by = np.bitwise_count(right_bits[first:last] ^ bits[x]).sum(1, dtype=np.int64)
        near = np.flatnonzero(apart_by <= (100 - threshold) * total // (100 + threshold))
        if not len(near):
            continue
        mark[codes[x]] = 1
        if 2 * len(near) > last - first:
            both = np.add.reduceat(mark[run[start[first]:start[last]]],
                                   start[first:last] - start[first])[near]
        else:
            of = np.concatenate([codes[y] for y in right[first + near].tolist()])
            both = np.add.reduceat(mark[of], np.concatenate(
                [[0], np.cumsum(right_size[first + near])[:-1]]))
        mark[codes[x]] = 0
        linked = right[first + near[100 * both >= threshold * (total[near] - both)]]
        degree[x] += len(linked)
        degree[linked] += 1
        p = find(x)
        for y in linked[parent[linked] != p].tolist():
            q = find(y)
            if p != q:
                parent[q] = p
                a.append(x)
                b.append(y)
    return np.array(a, np.int64), np.array(b, np.int64), degree


def components(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, k_id, k_tx, n_shingles, n_links, component_id) of every row.

    ``n_links`` counts all verified links between different sets at the row's set.
    """
    described = stored(describe_sets(docs, words, threshold), "gramrows")
    links, degree = link_sets(docs, described, words, threshold)
    roots = kept(connected_components(links)).withColumnRenamed("node", "set_id")
    rooted = (described.join(roots, "set_id", "left").join(degree, "set_id", "left")
              .withColumn("root", F.coalesce("root", "set_id")))
    smallest = rooted.where("root is not null").groupBy("root").agg(
        F.min("doc_id").alias("component_id"))
    joined = rooted.join(smallest, "root", "left")
    return joined.select("doc_id", "k_id", "k_tx", "n_shingles",
                         F.coalesce("n_links", F.lit(0)).alias("n_links"),
                         F.when(F.col("root").isNull(), F.col("doc_id"))
                         .otherwise(F.col("component_id")).alias("component_id"))


def op1_gram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_and_text(table(spark, sf_dir, "documents"))
    return components(docs).select("doc_id", "n_shingles", "component_id", "n_links")
