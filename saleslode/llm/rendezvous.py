"""Sharding by rendezvous hashing of record keys over weighted shards.

Every shard draws a number for a record from the hash of (key, shard) alone, and the record
goes to the shard whose draw is best. A shard that is added takes the records it wins and
moves no other; one that is removed gives up its own records only. With weights w a draw u
in (0, 1) is judged by -ln(u) / w, so a shard wins in proportion to its weight; with equal
weights the order of the draws is the same as that of u, which is then compared as it is.

Placing a record reads nothing but its key, so there is no shuffle. Slots (a gapless number
within the shard) are numbered by two counts: equal rows are one counted row, these are dealt
by the leading digits of their digest into cells of bounded size within the shard, cells are
numbered by prefix sums, and rows within their cell. No task holds a shard, and a row that
repeats without bound is one row until it is written out in stretches of ``STRETCH``.

Edge cases: a NULL key is a key of its own (one shard); repeated rows share the shard and have
a slot each; NULL and empty texts have no bytes; an empty table gives no rows; other columns
pass through ``place`` and are not read by the query. Where two shards draw the same number
(a chance of 2**-52 a pair) the record goes to the shard of the higher number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, stored, table

SHARDS = 40
OVERHEAD = 16
DRAW_DIGITS = 13
CELL_ROWS = 8192
STRETCH = 100_000


def equal_weights(count: int) -> dict[int, float]:
    return dict.fromkeys(range(count), 1.0)


def digest(*parts: Column) -> Column:
    """Hexadecimal digest of values side by side; NULL counts as an empty value."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def best_shard(key: Column, weights: Mapping[int, float]) -> Column:
    """Number of the shard that wins the key."""
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("a record needs at least one shard, and every shard a weight above 0")
    even = len(set(weights.values())) == 1
    shards = F.array(*[F.struct(F.lit(int(s)).alias("s"), F.lit(float(w)).alias("w"))
                       for s, w in sorted(weights.items())])

    def draw(shard: Column) -> Column:
        drawn = F.substring(digest(key, shard["s"]), 1, DRAW_DIGITS)
        if even:
            return F.struct(drawn.alias("u"), shard["s"].alias("s"))
        share = (F.conv(drawn, 16, 10).cast("double") + 0.5) / float(16 ** DRAW_DIGITS)
        return F.struct((F.log(share) / shard["w"]).alias("u"), shard["s"].alias("s"))

    return F.array_max(F.transform(shards, draw))["s"]


def place(rows: DataFrame, weights: Mapping[int, float], key: str = "doc_id",
          out: str = "shard") -> DataFrame:
    """Rows with the number of their shard; no row is shuffled."""
    return rows.withColumn(out, best_shard(F.col(f"`{key}`"), weights))


def moved(rows: DataFrame, before: Mapping[int, float], after: Mapping[int, float],
          key: str = "doc_id") -> DataFrame:
    """(old_shard, new_shard, records) of the records that a change of shards moves."""
    both = rows.select(best_shard(F.col(f"`{key}`"), before).alias("old_shard"),
                       best_shard(F.col(f"`{key}`"), after).alias("new_shard"))
    return (both.where("old_shard != new_shard").groupBy("old_shard", "new_shard")
            .agg(F.count("*").alias("records")))


def numbered(rows: DataFrame, columns: Sequence[str], shard: str = "shard",
             cell_rows: int = CELL_ROWS, stretch: int = STRETCH) -> DataFrame:
    """The given columns of every row with ``slot``, gapless from 0 within the shard.

    The order within a shard is that of the digest of the columns, so it does not depend on
    how the rows are stored.
    """
    names = [c for c in columns if c != shard]
    counted = (rows.groupBy(shard, *names).agg(F.count("*").alias("n_"))
               .withColumn("digest_", digest(*[F.col(c) for c in names])))
    counted = stored(counted, "slots")
    shape = counted.agg(F.count("*").alias("rows"),
                        F.approx_count_distinct(shard).alias("shards")).first()
    digits = 1
    while 16 ** digits * max(shape["shards"], 1) * cell_rows < shape["rows"]:
        digits += 1
    dealt = counted.withColumn("cell_", F.substring("digest_", 1, digits))
    earlier = Window.unboundedPreceding, -1
    starts = (dealt.groupBy(shard, "cell_").agg(F.sum("n_").alias("size_"))
              .withColumn("start_", F.coalesce(
                  F.sum("size_").over(Window.partitionBy(shard).orderBy("cell_")
                                      .rowsBetween(*earlier)), F.lit(0)))
              .drop("size_"))
    within = Window.partitionBy(shard, "cell_").orderBy("digest_", *names).rowsBetween(*earlier)
    first = (dealt.withColumn("before_", F.coalesce(F.sum("n_").over(within), F.lit(0)))
             .join(starts, [shard, "cell_"])
             .withColumn("first_", F.col("start_") + F.col("before_"))
             .select(shard, *names, "first_", "n_"))
    single = first.where("n_ = 1").select(shard, *names, F.col("first_").alias("slot"))
    pieces = (first.where("n_ > 1")
              .withColumn("piece_", F.explode(F.sequence(
                  F.lit(0).cast("long"), F.floor((F.col("n_") - 1) / stretch).cast("long"))))
              .repartition("first_", "piece_"))
    low, high = F.col("piece_") * stretch, F.least("n_", (F.col("piece_") + 1) * stretch) - 1
    many = pieces.select(shard, *names, "first_", F.explode(F.sequence(low, high)).alias("no_"))
    return single.unionByName(
        many.select(shard, *names, (F.col("first_") + F.col("no_")).alias("slot")))


def write_shards(rows: DataFrame, path: str, weights: Mapping[int, float], key: str = "doc_id",
                 rows_a_file: int = 1_000_000, writers: int = 16) -> None:
    """Parquet folders ``shard=N`` of whole rows; a shard is written by several tasks."""
    placed = place(rows, weights, key)
    dealt = placed.withColumn("writer_", F.monotonically_increasing_id() % writers)
    (dealt.repartition("shard", "writer_").drop("writer_")
     .write.option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(path))


def op11_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_and_text(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    records = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
                          F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = place(records, equal_weights(SHARDS))
    slots = numbered(placed, ["doc_id", "size", "text_crc32"])
    grown = place(slots, equal_weights(SHARDS + 1), out="grown_shard")
    return grown.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                        "slot", "grown_shard")


def op11_sql(shards: int = SHARDS) -> str:
    def best(count: int, name: str) -> str:
        return (f"list_max([substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', s)), "
                f"1, {DRAW_DIGITS}) || lpad(CAST(s AS VARCHAR), 9, '0') "
                f"for s in range({count})]) AS {name}")

    return rf"""
WITH t AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + {OVERHEAD} AS size,
         coalesce(text, '') AS text,
         {best(shards, "a")}, {best(shards + 1, "b")}
  FROM documents),
c AS (
  -- CRC-32 of the bytes by its definition, a byte at a time
  SELECT t.*, list_reduce(
      list_prepend(4294967295::BIGINT, [
        ('0x' || substr(hex(encode(text)), 2 * i - 1, 2))::BIGINT
        for i in range(1, octet_length(encode(text)) + 1)]),
      lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1])) AS r
  FROM t, (SELECT list(v ORDER BY n) AS crc FROM (
      SELECT n, list_reduce([n] || [0::BIGINT for i in range(8)],
             lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v
      FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256)))))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(r, 4294967295) AS BIGINT) AS text_crc32,
       'key' AS law, CAST(substr(a, {DRAW_DIGITS + 1}) AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY a_shard ORDER BY k, doc_id, size, x) - 1 AS slot,
       CAST(substr(b, {DRAW_DIGITS + 1}) AS INTEGER) AS grown_shard
FROM (SELECT *, substr(a, {DRAW_DIGITS + 1}) AS a_shard, xor(r, 4294967295) AS x,
             md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', size, ':',
                        xor(r, 4294967295))) AS k FROM c)
"""


OP11_SQL = op11_sql()
