"""Sharding, tokenizer alignment and ranked search against plain versions."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from saleslode.llm import alignment, rendezvous, treapsearch
from saleslode.llm.common import id_and_text

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Documents of (id, text) with other columns whose names clash with inner ones."""
    made = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], DOCS)
    for name in ("n_", "row", "shard", "slot", "score", "n", "terms", "pair"):
        made = made.withColumn(name, F.lit("clash"))
    return made


def odd_rows():
    """NULL ids, empties, ties, repeated rows, one id with two texts, a very long text."""
    r = random.Random(11)
    words = ["the", "of", "Cat", "dog", "ran", "über", "naïve", "x1", "2024", "\U0001F600"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 30))) for _ in range(60)]
    long = " ".join(r.choice(words) for _ in range(20_000))
    rows = list(enumerate([None, "", " \n", "cat", "cat", "Cat dog", *texts, long]))
    return rows + [(7, texts[1]), (7, texts[1]), (7, "another text of one id"), (None, "cat dog"),
                   (None, "cat dog"), (None, None), (900, "▁mark"), (901, "<s> <|endoftext|> é́")]


# ---- shards ----------------------------------------------------------------------------------

def best_of(key, weights):
    key = "" if key is None else str(key)

    def draw(s):
        u = (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16 ** 13
        return math.log(u) / weights[s], s

    return max(weights, key=draw)


@pytest.mark.parametrize("weights", [{0: 1, 1: 1, 2: 1}, {3: 0.5, 9: 2.0, 4: 1.0, 12: 7.5}])
def test_the_best_draw_wins(spark, weights):
    rows = spark.range(2000).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.shard for r in rendezvous.place(rows, weights).collect()}
    assert got == {i: best_of(i, weights) for i in range(2000)}
    share = collections.Counter(got.values())
    for shard, weight in weights.items():
        assert abs(share[shard] / 2000 - weight / sum(weights.values())) < 0.05


def test_a_new_shard_takes_only_into_itself(spark):
    rows = spark.range(3000).withColumnRenamed("id", "doc_id")
    before, after = rendezvous.equal_weights(7), rendezvous.equal_weights(8)
    moves = rendezvous.moved(rows, before, after).collect()
    assert {m.new_shard for m in moves} == {7}
    assert abs(sum(m.records for m in moves) - 3000 / 8) < 100
    back = rendezvous.moved(rows, after, before).collect()
    assert {m.old_shard for m in back} == {7}
    with pytest.raises(ValueError):
        rendezvous.place(rows, {0: 0.0})


@pytest.mark.parametrize("cell_rows,stretch", [(8192, 100_000), (2, 3)])
def test_slots_are_gapless_and_rows_whole(spark, cell_rows, stretch):
    rows = odd_rows() + [(5, "same")] * 20
    docs = id_and_text(frame(spark, rows)).withColumn("shard", F.lit(3))
    out = rendezvous.numbered(docs, ["doc_id", "text"], "shard", cell_rows, stretch).collect()
    assert collections.Counter((r.doc_id, r.text) for r in out) == collections.Counter(rows)
    assert sorted(r.slot for r in out) == list(range(len(rows)))


def test_shards_of_odd_rows(spark, tmp_path):
    rows = odd_rows()
    path = str(tmp_path / "tables")
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    out = rendezvous.op11_rendezvous(spark, path).collect()
    expected = collections.Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key",
         best_of(i, rendezvous.equal_weights(40)), best_of(i, rendezvous.equal_weights(41)))
        for i, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard)
                               for r in out) == expected
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    twin = con.sql(rendezvous.OP11_SQL).fetchall()
    assert collections.Counter(map(tuple, out)) == collections.Counter(twin)


def test_shards_are_written_whole(spark, tmp_path):
    rows = odd_rows()
    docs = id_and_text(frame(spark, rows))
    rendezvous.write_shards(docs, str(tmp_path / "out"), {0: 1.0, 1: 3.0}, rows_a_file=10,
                            writers=3)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert collections.Counter((r.doc_id, r.text) for r in back) == collections.Counter(rows)
    assert all(r.shard == best_of(r.doc_id, {0: 1.0, 1: 3.0}) for r in back)


# ---- alignment -------------------------------------------------------------------------------

def byte_alphabet():
    """Printable stand-ins of the byte-level vocabulary: bytes by character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


@pytest.fixture(scope="module")
def sides():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_alphabet()

    def encode(text):
        if not text:
            return None
        left = a.encode(" " + text, add_special_tokens=False).ids
        right = b.encode(text)
        left_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in left]
        right_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                       else b.id_to_piece(i).replace("▁", " ").encode() for i in right]
        whole = (" " + text).encode()
        if b"".join(left_bytes) != whole or b"".join(right_bytes) != whole:
            return None
        return left, left_bytes, right, right_bytes

    return encode


def plain_alignment(encoded):
    """Links as (i, j, bytes), groups as (a ids, b ids), by comparing byte spans."""
    left, left_bytes, right, right_bytes = encoded
    a_ends = np.cumsum([len(t) for t in left_bytes]).tolist()
    b_ends = np.cumsum([len(t) for t in right_bytes]).tolist()
    a_of = [i for i, t in enumerate(left_bytes) for _ in t]
    b_of = [j for j, t in enumerate(right_bytes) for _ in t]
    links = sorted((i, j, n) for (i, j), n in
                   collections.Counter(zip(a_of, b_of, strict=True)).items())
    ends = sorted(set(a_ends) & set(b_ends))
    groups, low = [], 0
    for end in ends:
        groups.append(([i for i, e in enumerate(a_ends) if low < e <= end],
                       [j for j, e in enumerate(b_ends) if low < e <= end]))
        low = end
    return links, groups


@pytest.mark.parametrize("pairs_a_part,links_a_group", [(4_000_000, 4_000_000), (20, 300)])
def test_alignment_equals_span_comparison(spark, sides, monkeypatch, pairs_a_part, links_a_group):
    monkeypatch.setattr(alignment, "PAIRS_A_PART", pairs_a_part)
    monkeypatch.setattr(alignment, "LINKS_A_GROUP", links_a_group)
    rows = [(i, t) for i, t in odd_rows() if len(t or "") < 10_000]
    held, count = [], collections.Counter()
    for doc, text in rows:
        encoded = sides(text)
        if encoded is None:
            held.append((doc, None))
            continue
        links, groups = plain_alignment(encoded)
        ids = [(encoded[0][i], encoded[2][j]) for i, j, _ in links]
        count.update(set(ids))
        held.append((doc, (encoded, ids, groups)))
    best = collections.Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    expected = collections.Counter()
    for doc, found in held:
        if found is None:
            expected[doc, 0, 0, 0, 0, 0, 0, "", 0] += 1
            continue
        encoded, ids, groups = found
        text = ";".join(",".join(str(encoded[0][i]) for i in a) + "|"
                        + ",".join(str(encoded[2][j]) for j in b) for a, b in groups)
        expected[doc, len(encoded[0]), len(encoded[2]), len(groups), len(ids),
                 sum(count[p] == best[p[0]] for p in ids), sum(count[p] for p in ids),
                 hashlib.sha256(text.encode()).hexdigest(),
                 sum(len(a) * len(b) for a, b in groups)] += 1
    got = collections.Counter(map(tuple, alignment.align(id_and_text(frame(spark, rows))).collect()))
    assert got == expected


def test_links_and_groups_are_listed(spark, sides, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 7)
    rows = [(1, "The naïve cat's 2024 \U0001F600 zigzagged über"), (2, None), (3, "dogs ran")]
    docs = id_and_text(frame(spark, rows))
    links, shared = set(), set()
    for doc, text in rows:
        encoded = sides(text)
        if encoded:
            found, groups = plain_alignment(encoded)
            links |= {(doc, i, j, encoded[0][i], encoded[2][j], n) for i, j, n in found}
            shared |= {(doc, i, j, encoded[0][i], encoded[2][j])
                       for a, b in groups for i in a for j in b}
    assert set(map(tuple, alignment.overlaps(docs).collect())) == links
    assert set(map(tuple, alignment.shared_groups(docs).collect())) == shared


def test_alignment_of_nothing(spark):
    assert alignment.align(id_and_text(frame(spark, []))).count() == 0
    (row,) = alignment.align(id_and_text(frame(spark, [(None, None)]))).collect()
    assert (row.doc_id, row.n_links, row.groups_sha256) == (None, 0, "")


def test_sparse_products_equal_dense_ones():
    r = np.random.default_rng(3)

    def sparse(dense):
        rows, columns = np.nonzero(dense)
        starts = np.searchsorted(rows, np.arange(len(dense) + 1))
        return alignment.Matrix(starts, columns, dense[rows, columns], dense.shape[1])

    def dense(matrix):
        out = np.zeros((len(matrix.starts) - 1, matrix.width), np.int64)
        out[matrix.row_of_each(), matrix.columns] = matrix.values
        return out

    for _ in range(30):
        n, m, k = r.integers(1, 9, 3)
        a = r.integers(0, 3, (n, m)) * (r.random((n, m)) < 0.5)
        b = r.integers(0, 3, (m, k)) * (r.random((m, k)) < 0.5)
        assert (dense(sparse(a) @ sparse(b)) == a @ b).all()
        assert (dense(sparse(a).transpose()) == a.T).all()
        assert (dense(sparse(a).rows(0, n)) == a).all()


# ---- ranked search ---------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lowered)


def plain_ranking(docs, items, top=10):
    lists = [(d, terms_of(t)) for d, t in docs]
    counted = [(d, len(w), collections.Counter(w)) for d, w in lists if w]
    n_docs, length = len(counted), sum(n for _, n, _ in counted)
    df = collections.Counter(t for _, _, c in counted for t in c)
    wanted = collections.defaultdict(set)
    for item, text in items:
        if item is not None:
            wanted[item] |= set(terms_of(text))
    out = collections.Counter()
    for item, terms in wanted.items():
        scored = []
        for doc, n, c in counted:
            m = 10 + (90 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, absent, doc) in enumerate(sorted(scored)[:top], 1):
            out[item, rank, None if absent else doc, -score] += 1
    return out


def items_frame(spark, items):
    made = spark.createDataFrame(items, "item_id long, text string")
    return made.withColumn("score", F.lit("clash")).withColumn("rank", F.lit("clash"))


@pytest.mark.parametrize("shard_docs,item_bytes", [(8192, 1 << 20), (5, 40), (1, 1)])
def test_ranking_equals_scoring_all(spark, monkeypatch, shard_docs, item_bytes):
    monkeypatch.setattr(treapsearch.build_index, "__defaults__", (shard_docs, 2_000_000))
    rows = odd_rows() + [(300 + i, "cat cat dog") for i in range(15)]
    items = [(1, "The CAT and the dog"), (2, "über 2024"), (3, None), (4, "..."), (None, "cat"),
             (5, "absent words only"), (6, "of of of x1"), (1, "naïve"), (7, "\U0001F600 cat")]
    got = treapsearch.ranked(id_and_text(frame(spark, rows)), items_frame(spark, items),
                             item_bytes=item_bytes)
    assert collections.Counter(map(tuple, got.collect())) == plain_ranking(rows, items)


def test_ranking_of_nothing(spark):
    none, some = id_and_text(frame(spark, [])), id_and_text(frame(spark, [(1, "cat")]))
    assert treapsearch.ranked(none, items_frame(spark, [(1, "cat")])).count() == 0
    assert treapsearch.ranked(some, items_frame(spark, []).limit(0)).count() == 0
    assert treapsearch.ranked(id_and_text(frame(spark, [(1, None)])),
                              items_frame(spark, [(1, "cat")])).count() == 0


def test_a_descent_halves_few_states():
    """The best documents of a rare term are found without looking at every column."""
    r = np.random.default_rng(5)
    width, height = 4096, 300
    rows = np.concatenate([np.repeat(299, 12), r.integers(0, 280, 60_000)])
    columns = np.concatenate([r.choice(width, 12, replace=False), r.integers(0, width, 60_000)])
    grid = np.zeros((height, width), np.int64)
    np.maximum.at(grid, (rows, columns), r.integers(1, 1000, len(rows)))
    rows, columns = np.nonzero(grid)
    treap = treapsearch.Treap.build(rows, columns, grid[rows, columns], height, width)
    treap = treapsearch.Treap.unpacked(**treap.packed())
    query, weight = np.array([3, 77, 299]), np.array([1, 1, 500])
    best = treapsearch.Best(10)
    halved = treapsearch.descend(treap, query, weight, list(range(width)), best, at_once=4)
    scores = weight @ grid[query]
    order = sorted(range(width), key=lambda c: (-scores[c], c))[:10]
    assert [(-s, d) for s, _, d in best.found] == [(scores[c], c) for c in order]
    assert halved < 400


def test_equal_first_hashes_are_told_apart():
    first = np.array([5, 5, 5, 9], np.uint64)
    second = np.array([1, 2, 3, 1], np.uint64)
    terms = treapsearch.Terms(first, second)
    assert terms.numbers(first, second).tolist() == [0, 1, 2, 3]
    assert terms.numbers(np.array([5, 9, 7], np.uint64), np.array([4, 2, 1], np.uint64)).tolist() == [
        -1, -1, -1]
