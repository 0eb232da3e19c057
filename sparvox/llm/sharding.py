"""Sharding by sampled splitters, in DataFrame operations only.

The law is 'bytes': shards get near equal bytes. Records are in the order of (hash of text, doc_id), so equal texts
are neighbours. A size-weighted sample of keys gives quantile splitters for many ranges; ranges that a single text
overfills are subdivided by doc_id. Sums over ranges then place every range, and a window within each range every record.
A group of equal texts of under a hundredth of a shard stays in one shard; a larger one is cut where the bytes say.

Defined results: a null text has size 1 and crc32 0; null doc_ids come first within their text; repeated rows are
placed one by one, in any order among themselves. An empty table gives no rows; a text longer than a shard's share stands in one
shard whole. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, stored


def _at_most(edges: list[int], key: Column) -> Column:
    """How many of the sorted edges are not above key; two levels of comparisons instead of one long one."""
    if not edges:
        return F.lit(0)
    step = max(1, int(len(edges) ** 0.5))
    groups = [edges[i : i + step] for i in range(0, len(edges), step)]
    coarse = F.size(F.filter(F.array(*[F.lit(g[0]) for g in groups]), lambda e: e <= key))
    fine = F.element_at(F.array(*[F.array(*[F.lit(e) for e in g]) for g in groups]), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(fine, lambda e: e <= key)))


def splitters(rows: DataFrame, total: int, ranges: int, draws: int = 32) -> list[int]:
    """Quantiles of a sample of keys in which a record's chance is its share of the bytes, draws keys a range."""
    chance = F.col("size") * F.lit(draws * ranges / max(total, 1))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(29), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("key")), 11) / F.lit(float(1 << 53))
    found = rows.where(unit < chance).agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
    return sorted(set(found or []))


def shard(docs: DataFrame, shards: int = 16, ranges: int = 1024, whole: float = 0.01) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document. ranges bounds how finely work is dealt out: a range holds about
    1/ranges of the bytes, so it should grow with the cluster; whole is the share of a shard up to which equal texts stay together."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = stored(docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    edges = splitters(rows, total, ranges)
    # Texts that may be cut. At most shards / whole texts can be so large: the table is bounded by that, whatever the input.
    heavy = stored(rows.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * shards > F.lit(whole * total)))
    heavy = heavy.select("key", "bytes", F.ceil(F.col("bytes") * 2 * ranges / F.lit(max(total, 1))).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(heavy), "key", "left")
    alone = F.col("bytes").isNotNull()
    # Of a heavy text, part p holds the doc_ids whose hash falls to it; parts of a text follow each other in the order.
    part = F.when(alone, F.pmod(F.xxhash64("doc_id"), F.col("parts")) + 1).otherwise(0).cast("int")
    dealt = dealt.select("doc_id", "size", "text_crc32", "key", _at_most(edges, F.col("key")).cast("int").alias("range"), F.when(alone, F.col("key")).alias("text"), part.alias("part"), F.col("bytes"))
    # Within a range come its light texts (part 0), then its heavy ones, text by text.
    dealt = stored(dealt)
    place = ["range", "text", "part"]
    sums = dealt.groupBy(*place).agg(F.sum("size").alias("range_bytes"), F.count("*").alias("range_rows"))
    before = W.orderBy("range", F.col("text").asc_nulls_first(), "part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col("range").alias("r"), F.col("text").alias("t"), F.col("part").alias("p"), F.coalesce(F.sum("range_bytes").over(before), F.lit(0)).alias("start"))
    joined = dealt.join(F.broadcast(starts), (F.col("range") == F.col("r")) & F.col("text").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p"))).drop("r", "t", "p")
    within = W.partitionBy(*place).orderBy("key", "doc_id")
    run = F.sum("size").over(within.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    rows = joined.withColumn("at", F.col("start") + run).withColumn("group_at", F.min("at").over(W.partitionBy(*place, "key")))
    first = F.when(F.col("bytes").isNull(), F.col("group_at")).otherwise(F.col("at"))
    rows = rows.withColumn("shard", F.least(F.floor(first * F.lit(shards) / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int"))
    rows = stored(rows.select("doc_id", "size", "text_crc32", "shard", "at", *place))
    # Slots: records of a range in a shard follow those of the ranges before it.
    counts = rows.groupBy("shard", *place).agg(F.count("*").alias("n"))
    lead = W.partitionBy("shard").orderBy("range", F.col("text").asc_nulls_first(), "part").rowsBetween(W.unboundedPreceding, -1)
    lead_rows = counts.select(F.col("shard").alias("s"), F.col("range").alias("r"), F.col("text").alias("t"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(lead), F.lit(0)).alias("first_slot"))
    nth = F.row_number().over(W.partitionBy("shard", *place).orderBy("at")) - 1
    rows = rows.withColumn("nth", nth).join(F.broadcast(lead_rows), (F.col("shard") == F.col("s")) & (F.col("range") == F.col("r")) & F.col("text").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p")))
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("nth")).cast("long").alias("slot"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
