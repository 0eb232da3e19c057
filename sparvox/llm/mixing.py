"""Mixing sources to target weights, in DataFrame operations only.

Defined results: size is the number of words, 0 for a null text; a null source is a source of its own, last in order;
if all sizes are 0, nothing is taken. The draw of a document is seeded by its doc_id, source and text (nulls as ''), so rows
that share a doc_id, or have none, are drawn one by one; rows equal in all three are decided alike, and every rerun agrees. An
empty table gives no rows. Texts of any length are counted whole. Columns other than doc_id, text and source pass through; those
that the operator adds have names that begin with __.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, documents, stored


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """totals (source, source_size), a row per source, gets target and rate.

    Water-filling in closed form: in the order of cap over weight, a source is at its cap when the level that the others
    would need reaches that ratio. One row a source, so its window is as small as the list of sources."""
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = totals.withColumn("__w", w).withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    by = W.orderBy((F.col("__cap") / F.col("__w")).asc(), F.col("source").isNull(), F.col("source").cast("binary"))
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    level = (total - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after)
    rows = rows.withColumn("__level", level).withColumn("__rank", F.row_number().over(by))
    free = F.col("__level") * F.col("__w") <= F.col("__cap")  # the first such source in the order sets the level for it and all after
    final = F.min(F.when(free, F.struct("__rank", "__level"))).over(W.partitionBy())["__level"]
    target = F.least(F.col("__cap"), F.coalesce(final * F.col("__w"), F.col("__cap")))
    rows = rows.withColumn("target", target.cast("double"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    return rows.withColumn("rate", rate).select("source", "source_size", "target", "rate")


def draw(seed: int) -> Column:
    """A number from 0 to 1 for each document, by hashes that any SQL engine can compute."""
    text = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("")), text)
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies_of(rate: Column, unit: Column) -> Column:
    """floor(rate) copies and one more with a chance of the fraction."""
    return F.floor(rate) + F.when(unit < rate - F.floor(rate), 1).otherwise(0)


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies) of every document.

    Sizes are summed per task before the one small shuffle; the list of sources joins back, and Spark broadcasts it only while it is small."""
    sizes = stored(docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), draw(seed).alias("unit")))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, most).withColumnRenamed("source", "__source")
    rows = sizes.join(targets, sizes["source"].eqNullSafe(F.col("__source"))).drop("__source")
    return rows.withColumn("copies", copies_of(F.col("rate"), F.col("unit")).cast("int")).drop("unit")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 17) -> DataFrame:
    """The documents, each as many times as the mix takes it."""
    totals = docs.select("source", words_of(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(totals, weights, most)).select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    rows = docs.join(targets, docs["source"].eqNullSafe(F.col("__source")))
    some = rows.withColumn("__times", copies_of(F.col("__rate"), draw(seed)).cast("int")).where("__times > 0")
    return some.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


OP6_SQL = r"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, sha256(coalesce(text, '')) AS digest FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY 1),
weighed AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM totals),
levels AS (SELECT *, row_number() OVER o AS place,
    (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed WINDOW o AS (ORDER BY cap / w, source IS NULL, encode(source))),
final AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, place) FROM levels WHERE level * w <= cap) * w, cap)) AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0 END AS rate FROM final),
drawn AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.rate,
    CAST('0x' || substr(sha256('17:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || coalesce(d.source, '') || ':' || d.digest), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS unit
    FROM sizes d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, rate, copies
FROM (SELECT *, CAST(floor(rate) + CASE WHEN unit < rate - floor(rate) THEN 1 ELSE 0 END AS INT) AS copies FROM drawn)
"""
