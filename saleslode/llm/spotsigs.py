"""Document fingerprints: spot signatures, compared by pruned Jaccard.

Everything here is DataFrame functions. A text is lower-cased and reduced to its words; each
common word (an anchor) that content words follow opens a chain of up to ``CHAIN`` content
words, up to the next common word. The set of the 64-bit hashes of anchor and chain is the
document's fingerprint. A text with fewer than ``FEW`` chains is fingerprinted by all its
words instead (also where fewer than one word in ``SPARSE`` opens a chain), and with fewer than
``FEW`` words by its letter triples, so that short texts and texts without common words are
told apart too. Two texts are compared by signatures of one kind: where their own kinds
differ, both by the one that the other falls back to (chains, then words, then triples).

Two sets can be alike to a degree t only if the smaller has at least t times the size of the
larger: sets are partitioned by size so that this holds for the same partition and the next
one only, and sets further apart are told unlike without being intersected.

Edge cases: NULL and empty texts have the empty fingerprint; two empty ones are alike (1.0),
an empty one and another are not (0.0); repeated rows are listed each, and follow each
other in the order of their texts; rows with a NULL id come after all others; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NO_ID, id_and_text, table

CHAIN = 3
FEW = 4
SPARSE = 12
DEGREE = 0.02
BUCKET = 256

# Common words of English, German, French and Spanish.
COMMON = (
    "a an and are as at be but by for from had has have he his in is it not of on or that the "
    "their there they this to was were which with "
    "als auch auf aus bei das dem den der des die ein eine einer er es für hat im ist mit nach "
    "nicht sich sie sind und von war wie zu zum "
    "au aux avec ce cette dans de du elle en est et il je la le les mais ne ou où par pas plus "
    "pour que qui sa se ses son sont sur un une "
    "al como con del el ella era esta lo los las más no para pero por su sus sin una unos y ya"
).split()


MARK = "\u0001"
SPOT = f"{MARK}([^ ]+ (?:[^ {MARK}]+ ){{1,{CHAIN}}})"


def words_of(text: Column) -> Column:
    """Words in lower case: runs of letters and digits."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lower, r"[^\p{L}\p{N}]+"), "")


def hashed(values: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(values, lambda v: F.xxhash64(v))))


CHAINS, SINGLES, TRIPLES = 0, 1, 2


def spots_of(words: Column) -> Column:
    """Anchors with their chains, in order, a blank after each word.

    Words are looked up in a hash set and the anchors marked with a character that no word
    holds, so the pattern only walks from mark to mark.
    """
    marked = F.transform(words, lambda w: F.when(w.isin(*COMMON), F.concat(F.lit(MARK), w))
                         .otherwise(w))
    return F.regexp_extract_all(F.concat(F.array_join(marked, " "), F.lit(" ")), F.lit(SPOT), 1)


def triples_of(text: Column) -> Column:
    """Every three characters in a row, or a shorter text as a whole; one walk over the text."""
    def runs(chars):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(chars) - 2, F.lit(1))),
                           lambda i: F.array_join(F.slice(chars, i, 3), ""))

    letters = F.coalesce(text, F.lit(""))
    triples = F.transform(F.array(F.split(letters, "")), runs)[0]
    return F.when(F.length(letters) > 0, triples).otherwise(F.array().cast("array<string>"))


def signature_kind(spots: Column, words: Column) -> Column:
    """The first of the three kinds that a text has enough signatures of."""
    count = F.size(words)
    return (F.when((F.size(spots) >= FEW) & (F.size(spots) * SPARSE >= count), CHAINS)
            .when(count >= FEW, SINGLES).otherwise(TRIPLES))


def signature_set(kind: Column, spots: Column, words: Column, text: Column) -> Column:
    """Sorted distinct signatures of one kind of a text."""
    return hashed(F.when(kind == CHAINS, spots).when(kind == SINGLES, words)
                  .otherwise(triples_of(text)))


def fingerprint(signatures: Column) -> Column:
    """Text form: the signatures in hexadecimal, in order."""
    return F.array_join(F.transform(signatures, lambda v: F.hex(v)), "")


def size_partition(signatures: Column, degree: float) -> Column:
    """Partition of a set by its size: alike sets are in the same one or in neighbours."""
    return F.floor(F.log(F.size(signatures)) / F.log(F.lit(1 / degree)))


def likeness(a: Column, b: Column, degree: float = DEGREE) -> Column:
    """Jaccard similarity, or 0 where set sizes rule out ``degree`` or more."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    total = F.size(a) + F.size(b)
    apart = F.abs(size_partition(a, degree) - size_partition(b, degree)) > 1
    return (F.when(total == 0, F.lit(1.0))
            .when((F.least(F.size(a), F.size(b)) == 0) | apart, F.lit(0.0))
            .otherwise(both / (total - both)))


def with_parts(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Kind and signatures of a text, in ``{name}_kind`` and ``{name}``."""
    words, spots, kind = (F.col(f"{name}_{part}") for part in ("words", "spots", "kind"))
    return (docs.withColumn(f"{name}_words", words_of(F.col(text)))
            .withColumn(f"{name}_spots", spots_of(words))
            .withColumn(f"{name}_kind", signature_kind(spots, words))
            .withColumn(name, signature_set(kind, spots, words, F.col(text)))
            .drop(f"{name}_words", f"{name}_spots"))


def with_signatures(docs: DataFrame, text: str = "text", name: str = "signatures") -> DataFrame:
    return with_parts(docs, text, name).drop(f"{name}_kind")


def with_pair(docs: DataFrame, a: str, a_text: str, b: str, b_text: str, out: str,
              degree: float = DEGREE) -> DataFrame:
    """Likeness of two texts of ``with_parts`` by the kind that either of them falls back to.

    A set of the other's kind is made once a row, and only where the kinds differ.
    """
    kind, sets = F.greatest(F.col(f"{a}_kind"), F.col(f"{b}_kind")), (f"_{out}_a", f"_{out}_b")

    def by_kind(name, text):
        other = hashed(F.when(kind == SINGLES, words_of(F.col(text)))
                       .otherwise(triples_of(F.col(text))))
        return F.when(F.col(f"{name}_kind") == kind, F.col(name)).otherwise(other)

    return (docs.withColumns(dict(zip(sets, (by_kind(a, a_text), by_kind(b, b_text)), strict=True)))
            .withColumn(out, likeness(F.col(sets[0]), F.col(sets[1]), degree)).drop(*sets))


def next_ids(docs: DataFrame) -> DataFrame:
    """(bucket, follower): for each bucket of ids the next lower bucket that holds a row.

    Ids are cut into buckets, buckets into buckets of buckets and so on; each level is one
    window over few rows, and its last row is joined to the level above.
    """
    shift = BUCKET.bit_length() - 1
    levels = [docs.select("bucket").distinct()]
    while len(levels) < 4:
        above = F.shiftright(F.col("bucket"), shift * 2).alias("bucket")
        levels.append(levels[-1].select(above).distinct())
    top = Window.orderBy(F.desc("bucket"))
    known = levels[-1].select("bucket", F.lead("bucket").over(top).alias("follower"))
    for level in reversed(levels[:-1]):
        rows = level.withColumn("up", F.shiftright("bucket", shift * 2))
        inner = rows.withColumn("follower", F.lead("bucket").over(
            Window.partitionBy("up").orderBy(F.desc("bucket"))))
        highest = rows.groupBy("up").agg(F.max("bucket").alias("highest"))
        outer = known.join(highest.withColumnRenamed("up", "follower"), "follower").select(
            F.col("bucket").alias("up"), "highest")
        known = inner.join(outer, "up", "left").select(
            "bucket", F.coalesce("follower", "highest").alias("follower"))
    return known


def placed_rows(docs: DataFrame) -> DataFrame:
    """The rows with ``at``, their id or the value of none, and their bucket of ids."""
    shift = BUCKET.bit_length() - 1
    return docs.withColumn("at", F.coalesce("doc_id", F.lit(NO_ID))).withColumn(
        "bucket", F.shiftright("at", shift))


def with_next(docs: DataFrame, text: str = "text", parts=None) -> DataFrame:
    """The rows and ``next_text``, the text of the next document by falling id.

    Rows lie in buckets of ``BUCKET`` neighbouring ids. Within one the next row is a window
    function; the last row of a bucket gets the first text of the next bucket, and the last of
    all the first of all. ``parts`` adds columns made from a row's text: they are made once a
    row, after the rows are in order, and the next row's come along as ``next_{column}``.
    """
    parts = parts or (lambda df: df)
    order = [F.desc("at"), F.col(text).asc_nulls_first()]
    inside = Window.partitionBy("bucket").orderBy(*order)
    rows = placed_rows(docs)
    known = {*rows.columns} - {text}

    def of_next(df):
        # NULL is empty, so that only a missing row is NULL.
        return F.struct(*[(F.coalesce(c, F.lit("")) if c == text else F.col(c)).alias(c)
                          for c in df.columns if c not in known])

    numbered = rows.withColumn("no", F.row_number().over(inside)).where("no = 1")
    heads = parts(numbered.select(F.col("bucket").alias("follower"), text))
    heads = heads.select("follower", of_next(heads.drop("follower")).alias("head"))
    links = next_ids(rows)
    first = links.agg(F.max("bucket").alias("first"))
    links = links.join(F.broadcast(first), F.lit(True)).select(
        "bucket", F.coalesce("follower", "first").alias("follower"))
    ordered = parts(rows.repartition("bucket").sortWithinPartitions(F.asc("bucket"), *order))
    placed = ordered.withColumn("following", F.lead(of_next(ordered)).over(inside))
    joined = placed.join(links.join(heads, "follower").select("bucket", "head"), "bucket", "left")
    following = F.coalesce("following", "head")
    own = [c for c in ordered.columns if c not in ("at", "bucket")]
    return joined.withColumn("following", following).select(
        *own, *[F.col(f"following.{c}").alias(f"next_{c}")
                for c in ordered.columns if c not in known])


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(id_and_text(table(spark, sf_dir, "documents")),
                     parts=lambda df: with_parts(df, "text", "own"))
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumn("text", text).withColumn("n_chars", F.length("text"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - cut),
                      F.substring("next_text", F.lit(1), cut))
    rows = with_parts(docs.withColumn("edited", edited), "edited", "changed")
    rows = with_pair(rows, "own", "text", "changed", "edited", "near_edited")
    rows = with_pair(rows, "own", "text", "next_own", "next_text", "near_next")
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        "near_edited", "near_next")
