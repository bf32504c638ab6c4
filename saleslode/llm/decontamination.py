"""Benchmark decontamination over a distributed positional inverted index.

Everything on the main path is DataFrame functions. Words are runs of ASCII digits, ASCII
letters (A-Z lower-cased) and bytes above 0x7F. The index maps terms to their positions in
the training documents, and holds the terms it is built for. For every item window the
rarest of its terms (by documents that hold it, counted over all of them) is the one whose
postings are read; each posting, adjusted by the term's offset in the item, is a place
where the item may stand. The words around such a place are compared with the item's, so a
match is exact. The other terms' postings, which a common word would make as long as the
corpus, are never read. ``proximity_matches`` intersects position lists in order of rarity
instead, and finds the terms of an item within a span, in any order.

The item table is small beside the corpus but not bounded: tables made from it are stored,
counted and broadcast only up to ``BROADCAST_ROWS`` rows; beyond, joins are shuffled.

Edge cases: NULL and empty texts have no words, are never hit and are not contaminated;
repeated documents are reported each; items without words never occur; a repeated item id
is one item with several texts; NULL item ids are left out; empty tables give no rows (no
documents) or no hits (no items); other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_and_text, kept, row_key, table

WINDOW = 13
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text in order; none for NULL."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BREAK), "")


def small(df: DataFrame) -> DataFrame:
    """Stored table, marked for broadcast only if it has few rows."""
    df = kept(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def postings(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(k_id, k_tx, term, position) of the given terms; ``words`` has keys and ``words``."""
    flat = words.select("k_id", "k_tx", F.posexplode("words").alias("position", "term"))
    return flat.join(small(terms.select("term").distinct()), "term")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, text_no, words, position, term) of the items' words."""
    texts = (items.where("item_id is not null")
             .select("item_id", words_of(F.col("text")).alias("words")).distinct()
             .where(F.size("words") > 0)
             .withColumn("text_no", F.xxhash64("words")))
    return texts.select("item_id", "text_no", "words",
                        F.posexplode("words").alias("position", "term"))


def document_counts(docs_words: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, documents) for the given terms, over all documents."""
    held = docs_words.select(F.explode(F.array_distinct("words")).alias("term"))
    held = held.join(small(terms.select("term").distinct()), "term")
    return held.groupBy("term").agg(F.count("*").alias("documents"))


def rarest_places(terms: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """Item positions whose term is the rarest of at least one window of its item."""
    rated = terms.join(counts, "term", "left").withColumn(
        "rank", F.struct(F.coalesce("documents", F.lit(0)).alias("n"), "position"))
    ahead = (Window.partitionBy("item_id", "text_no").orderBy("position")
             .rowsBetween(0, window - 1))
    chosen = (rated.withColumn("best", F.min("rank").over(ahead)["position"])
              .where((F.col("position") == 0) | (F.col("position") + window <= F.size("words"))))
    places = chosen.select("item_id", "text_no", F.col("best").alias("position")).distinct()
    return rated.drop("documents", "rank").join(places, ["item_id", "text_no", "position"])


def places_with_words(docs_words: DataFrame, terms: DataFrame, window: int) -> DataFrame:
    """(k_id, k_tx, term, at, here): places of the terms, with the words within a window of them.

    Terms that can be broadcast meet the words of a document where they are read. More terms
    meet the bare postings; their positions go back to the documents as one list each, so a
    document's words are shuffled once and not once for each of its words.
    """
    def around(at: Column) -> Column:
        return F.slice("words", F.greatest(at - window + 2, F.lit(1)),
                       F.least(at, F.lit(window - 1)) + window)

    terms = kept(terms.select("term").distinct())
    if terms.count() <= BROADCAST_ROWS:
        flat = docs_words.select("k_id", "k_tx", "words", F.posexplode("words").alias("at", "term"))
        found = flat.join(F.broadcast(terms), "term")
    else:
        lists = (postings(docs_words, terms).groupBy("k_id", "k_tx")
                 .agg(F.collect_set(F.struct("position", "term")).alias("places")))
        found = (docs_words.join(lists, ["k_id", "k_tx"])
                 .select("k_id", "k_tx", "words", F.explode("places").alias("place"))
                 .select("k_id", "k_tx", "words", F.col("place.position").alias("at"),
                         F.col("place.term").alias("term")))
    return found.select("k_id", "k_tx", "term", "at", around(F.col("at")).alias("here"))


def exact_matches(docs_words: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k_id, k_tx, item_id, first, last): stretches of document words that are in matches."""
    terms = kept(item_terms(items))
    places = rarest_places(terms, document_counts(docs_words, terms), window)
    seeds = small(places.select("term", "item_id", "position", F.size("words").alias("item_size"),
                                F.slice("words", F.greatest(F.col("position") - window + 2,
                                                            F.lit(1)),
                                        F.least(F.col("position"), F.lit(window - 1)) + window)
                                .alias("around")))
    found = places_with_words(docs_words, seeds, window)
    pairs = found.join(seeds, "term")
    mine = F.least("at", F.lit(window - 1))
    its = F.least("position", F.lit(window - 1))

    def equal_run(a: Column, b: Column) -> Column:
        """How many leading words of two lists are equal."""
        same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        stop = F.array_position(same, F.lit(False))
        return F.when(stop > 0, stop - 1).otherwise(F.size(same)).cast("int")

    left = equal_run(F.reverse(F.slice("here", F.lit(1), mine)),
                     F.reverse(F.slice("around", F.lit(1), its)))
    right = equal_run(F.slice("here", mine + 1, F.size("here")),
                      F.slice("around", its + 1, F.size("around")))
    return (pairs.withColumn("l", left).withColumn("r", right)
            .where(F.col("l") + F.col("r") >= F.least(F.lit(window), F.col("item_size")))
            .select("k_id", "k_tx", "item_id", (F.col("at") - F.col("l")).alias("first"),
                    (F.col("at") + F.col("r") - 1).alias("last")))


def proximity_matches(docs_words: DataFrame, items: DataFrame, span: int,
                      terms_used: int = 3) -> DataFrame:
    """(k_id, k_tx, item_id, at): the item's rarest terms all within ``span`` words, any order.

    Position lists are joined from the rarest term on; ``at`` is a place of that term.
    """
    terms = kept(item_terms(items))
    counts = document_counts(docs_words, terms)
    order = Window.partitionBy("item_id", "text_no").orderBy("documents", "term")
    chosen = (terms.select("item_id", "text_no", "term").distinct().join(counts, "term", "left")
              .fillna(0, ["documents"]).withColumn("no", F.row_number().over(order))
              .where(F.col("no") <= terms_used))
    chosen = kept(chosen)
    index = kept(postings(docs_words, chosen))
    live = (index.join(chosen.where("no = 1").select("item_id", "text_no", "term"), "term")
            .select("k_id", "k_tx", "item_id", "text_no", F.col("position").alias("at")).distinct())
    sizes = chosen.groupBy("item_id", "text_no").agg(F.max("no").alias("need"))
    for number in range(2, terms_used + 1):
        wanted = chosen.where(F.col("no") == number).select("item_id", "text_no", "term")
        near = index.join(wanted, "term").select("k_id", "k_tx", "item_id", "text_no", "position")
        keys = ["k_id", "k_tx", "item_id", "text_no"]
        met = (live.join(near, keys).where(F.abs(F.col("position") - F.col("at")) < span)
               .select(*keys, "at").distinct())
        short = live.join(sizes.where(F.col("need") < number), ["item_id", "text_no"], "left_semi")
        live = met.unionByName(short.select(*met.columns))
    return live.select("k_id", "k_tx", "item_id", "at").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, hit words, items with occurring windows and their digest."""
    items = items.select(F.col("item_id"), F.col("text").cast("string").alias("text"))
    rows = docs.select("doc_id", *row_key(), words_of(F.col("text")).alias("words"))
    spans = kept(exact_matches(rows.select("k_id", "k_tx", "words"), items, window).distinct())
    hits = (spans.select("k_id", "k_tx", F.explode(F.sequence("first", "last")).alias("at"))
            .distinct().groupBy("k_id", "k_tx").agg(F.count("*").alias("n_hit")))
    named = (spans.select("k_id", "k_tx", F.col("item_id").cast("string").alias("item"))
             .distinct().groupBy("k_id", "k_tx")
             .agg(F.count("*").alias("n_items"),
                  F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items")))
    sizes = rows.select("doc_id", "k_id", "k_tx", F.size("words").cast("long").alias("n_words"))
    joined = sizes.join(hits.join(named, ["k_id", "k_tx"]), ["k_id", "k_tx"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "k_id", "k_tx", "n_words", n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(id_and_text(table(spark, sf_dir, "documents")),
                          table(spark, sf_dir, "benchmark"))
    return found.drop("k_id", "k_tx")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k,
         array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b
        WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes
        WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
