"""Mixing sources to target weights, in DataFrame operations only.

Tokens are summed per source, targets follow from the weights, and each document is taken
floor(rate) times plus once more with probability equal to the fraction, decided by a hash.  The
hash gives each document SEEDS numbers in [0, 1); each source takes the seed with which its words come
nearest to its target, the smallest of equal ones.  So sources of few documents come near their
targets too.

Defined results: a null source is a source of its own and comes last; a null or empty text has
size 0 and is taken 0 words; a source of size 0 has target 0; rows that repeat a doc_id share its
hash; an empty table gives an empty result.  mixed() passes all columns through unchanged, whatever
their names; mixed_counts() reads doc_id, source and text and returns its own columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, table, written

#: Sources that one task may order and a broadcast may hold; beyond it they are ordered in ranges and
#: their rates are joined by a shuffle.
BROADCAST_SOURCES = 50_000
#: Seeds that a source chooses from.
SEEDS = 32
#: Hexadecimal digits of the hash that make the coin.
DIGITS = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed(doc_id: Column, salt: int) -> Column:
    """A whole number of 52 bits that depends on the id and the salt alone."""
    key = F.concat(F.lit(f"{salt}|"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def coin(hash_: Column, seed: Column) -> Column:
    """A number in [0, 1) for each hash and each seed from 0 to 31."""
    bits = F.lit(1 << 4 * DIGITS)
    return F.pmod(hash_ * (seed * 64 + 1), bits).cast("double") / bits.cast("double")


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """df with the sum of each expression over all rows before a row; order leaves no ties.

    Few rows are summed by one window.  Many are sorted into ranges, which are written so that they
    stay; each range sums its own rows, and the sums of the ranges, a row each, give the rest.
    """
    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    if df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return df.withColumns({k: F.coalesce(F.sum(v).over(w), F.lit(0)) for k, v in sums.items()})
    ranged, _ = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    w = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = ranged.withColumns({k: F.coalesce(F.sum(v).over(w), F.lit(0)) for k, v in sums.items()})
    w = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    whole = ranged.groupBy("_range").agg(*[F.sum(v).alias(f"_{k}") for k, v in sums.items()])
    before = whole.select("_range", *[F.coalesce(F.sum(f"_{k}").over(w), F.lit(0)).alias(f"_{k}") for k in sums])
    return inside.join(F.broadcast(before), "_range").withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_range", *[f"_{k}" for k in sums])


def source_targets(sizes: DataFrame, weights=(5, 2, 1), percent: int = 150, most: int = 2) -> DataFrame:
    """source, source_size, target of a table (source, size).

    Each uncapped source gets weight times one common level.  With the sources ordered by
    cap / weight, level_k is what the uncapped rest would get if those before k were at their
    caps; the first k that stays within its own cap gives the level, which is also the largest
    level among those that do.  That is the fixed point of sharing excess again by weight.
    """
    per, _ = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    per = running(per, [F.col("source").asc_nulls_last()], _rank=F.lit(1))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long"))
    per, _ = written(per.withColumn("cap", F.col("source_size") * most).drop("_rank"), "mix-weights")
    size, weight = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    per = running(per, [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()], _caps=F.col("cap"), _weights=F.col("w"))
    left, share = F.lit(size).cast("long") * percent - 100 * F.col("_caps"), 100 * (F.lit(weight).cast("long") - F.col("_weights"))
    per = per.withColumn("level", left.cast("double") / share.cast("double"))
    per, _ = written(per, "mix-levels")
    level = per.agg(F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level")))).first()[0]
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.lit(level).cast("double")).alias("target"))


def with_rates(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Join the targets' columns to rows by source, null to null, as _mix_size, _mix_target and, if they have it, _mix_seed."""
    names = {"source": "_mix_source", "source_size": "_mix_size", "target": "_mix_target", "seed": "_mix_seed"}
    targets = targets.select(*[F.col(c).alias(names[c]) for c in targets.columns])
    small = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(targets) if small else targets, F.col("source").eqNullSafe(F.col("_mix_source"))).drop("_mix_source")


def copies(hash_: Column, seed: Column) -> Column:
    """How often a row is taken, given its hash and its source's seed."""
    rate = F.when(F.col("_mix_size") > 0, F.col("_mix_target") / F.col("_mix_size")).otherwise(0.0)
    return (F.floor(rate) + F.when(coin(hash_, seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def seeded_targets(sized: DataFrame, salt: int, **rule) -> DataFrame:
    """source, source_size, target and seed of a table (doc_id, source, size): targets with the seed that comes nearest."""
    rows = with_rates(sized, written(source_targets(sized.select("source", "size"), **rule), "mix-targets")[0])
    rows = rows.withColumn("_hash", hashed(F.col("doc_id"), salt))
    sums = [F.sum(F.col("size") * copies(F.col("_hash"), F.lit(k))).alias(f"_sum{k}") for k in range(SEEDS)]
    per = rows.groupBy("source").agg(F.any_value("_mix_size").alias("source_size"), F.any_value("_mix_target").alias("target"), *sums)
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"_sum{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(SEEDS)]))
    return written(per.select("source", "source_size", "target", nearest["k"].alias("seed")), "mix-seeds")[0]


def _sized(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")[0]


def mixed_counts(docs: DataFrame, salt: int = 7, **rule) -> DataFrame:
    """doc_id, source, size, source_size, target, n_copies and taken (words) of every document."""
    sized = _sized(docs)
    out = with_rates(sized, seeded_targets(sized, salt, **rule)).withColumn("n_copies", copies(hashed(F.col("doc_id"), salt), F.col("_mix_seed")))
    return out.select("doc_id", "source", "size", F.col("_mix_size").alias("source_size"), F.col("_mix_target").alias("target"), "n_copies", (F.col("n_copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, salt: int = 7, **rule) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, all columns as they were."""
    rows = with_rates(docs, seeded_targets(_sized(docs), salt, **rule)).withColumn("_mix_copies", copies(hashed(F.col("doc_id"), salt), F.col("_mix_seed")))
    some = F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))
    return rows.where("_mix_copies > 0").withColumn("_mix_copy", F.explode(some)).select(*docs.columns)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL_TARGETS = """
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, 2 * source_size AS cap,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w
  FROM per),
levels AS (
  SELECT *, CAST((SELECT sum(source_size) FROM weighted) * 150
      - 100 * coalesce(sum(cap) OVER before, 0) AS DOUBLE)
    / CAST(100 * ((SELECT sum(w) FROM weighted) - coalesce(sum(w) OVER before, 0)) AS DOUBLE) AS level
  FROM weighted
  WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE),
    w * (SELECT max(level) FROM levels WHERE level <= CAST(cap AS DOUBLE) / w)) AS target
  FROM levels)"""

SQL = {
    "op8_mix_sources": f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS hash
  FROM documents),
{SQL_TARGETS},
rated AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0::DOUBLE END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
tries AS (
  SELECT source, k, any_value(target) AS target,
         sum(size * CAST(floor(rate) + CASE WHEN CAST((hash * (64 * k + 1)) % 4503599627370496 AS DOUBLE) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT)) AS words
  FROM rated, range(32) AS r(k) GROUP BY source, k),
chosen AS (SELECT source, min_by(k, (abs(CAST(words AS DOUBLE) - target), k)) AS k FROM tries GROUP BY source)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN CAST((hash * (64 * k + 1)) % 4503599627370496 AS DOUBLE) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM rated r JOIN chosen c ON r.source IS NOT DISTINCT FROM c.source
""",
}
