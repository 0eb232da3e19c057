"""Line dedup by levelled sorted runs of line hashes.

Documents come in batches of rising doc_id. Each batch is anti-joined with the runs so far: a line key found there
belongs to an earlier document; the others are the batch's own and become a new run. A run is a table bucketed and
sorted by key hash, so the merge reads it in place and only the batch is shuffled. When a level holds fanout runs they
are merged into one of the next level.

The table of runs lies in the shared folder. A line that very many documents hold is one key of each batch, and only its
occurrences meet that key, in a join whose larger side Spark's adaptive execution deals out.

Defined results: a null or empty text is one empty line; a null doc_id sorts after all others and counts as 2^63 - 1; rows with
one doc_id count as one document, so a key found only there keeps all its lines. Repeated rows are treated alike; an empty table
gives no rows; texts and lines may be of any length. Other columns pass through untouched, but for n_lines and n_dropped, which
the operator's own replace; names that begin with __ are its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, discard, documents, stored

LAST = (1 << 63) - 1
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A to Z in lower case. lower() is several times as fast as
    translate() but also maps other letters, so it serves lines of ASCII alone."""
    stripped = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    plain = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(plain, F.lower(stripped)).otherwise(F.translate(stripped, A_TO_Z, A_TO_Z.lower()))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LevelledRuns:
    """Levels of sorted runs with columns h, g (the key) and owner (its first document)."""

    def __init__(self, buckets: int, fanout: int = 3):
        self.buckets, self.fanout, self.levels = buckets, fanout, []

    def _write(self, df: DataFrame) -> DataFrame:
        return bucketed(df.select("h", "g", "owner").repartition(self.buckets, "h", "g"), self.buckets, "h", "g")

    def tables(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, df: DataFrame) -> None:
        """Add a batch's own keys as a run of the lowest level; full levels are compacted upwards. Keys of runs are disjoint."""
        new, at = self._write(df), 0
        while True:
            if at == len(self.levels):
                self.levels.append([])
            self.levels[at].append(new)
            if len(self.levels[at]) < self.fanout:
                return
            old, self.levels[at] = self.levels[at], []
            new = self._write(reduce(DataFrame.unionByName, old))
            discard(*old)
            at += 1

    def drop(self) -> None:
        discard(*self.tables())
        self.levels = []


def repeated_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4) -> DataFrame:
    """(id, row, drop): for each document with lines to lose, the places of those whose key an earlier document holds.

    row is the hash of the text: documents that share a doc_id are told apart by it. Keys are hashed once, to 128 bits (two
    hashes under different seeds)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), text_row(F.col("text")).alias("row"), text_lines(F.col("text")).alias("lines"))  # row is hashed here, once a text: beside the explode it would be once a line
    edges = rows.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    batch = sum((F.when(F.col("id") > e, 1).otherwise(0) for e in sorted(set(edges))), F.lit(0))
    each = rows.select("id", "row", batch.cast("int").alias("batch"), F.posexplode("lines").alias("pos", "line"))
    each = each.withColumn("line", line_key(F.col("line"))).where(F.char_length("line") >= min_chars)
    lines = stored(each.select("id", "row", "pos", "batch", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")), "batch")
    runs = LevelledRuns(buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    drops = None
    try:
        for b in range(len(set(edges)) + 1):
            own = lines.where(F.col("batch") == b).select("id", "row", "pos", "h", "g")
            keys = own.groupBy("h", "g").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
            for i, run in enumerate(runs.tables()):  # keys of runs are disjoint: at most one of them knows the owner
                keys = keys.join(run.withColumnRenamed("owner", f"owner{i}"), ["h", "g"], "left")
            known = F.coalesce(*[F.col(f"owner{i}") for i in range(len(runs.tables()))], F.lit(None).cast("long"))
            keys = stored(keys.select("h", "g", "first_id", "last_id", known.alias("known")))
            runs.add(keys.where("known IS NULL").select("h", "g", F.col("first_id").alias("owner")))
            shared = keys.where("known IS NOT NULL OR first_id < last_id").select("h", "g", F.coalesce("known", "first_id").alias("owner"))
            lost = stored(own.join(shared, ["h", "g"]).where("id <> owner").select("id", "row", "pos"))
            drops = lost if drops is None else drops.unionByName(lost)
    finally:
        runs.drop()
    return stored(drops.groupBy("id", "row").agg(F.collect_set("pos").alias("drop")))


def text_row(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def flags_of(places: Column) -> Column:
    """Booleans up to the largest place, true at the places: unlike the list, it tells of any line in one step."""
    at = F.array_sort(places)
    before = F.concat(F.array(F.lit(-1)), F.slice(at, 1, F.size(at) - 1))
    return F.flatten(F.zip_with(at, before, lambda a, b: F.concat(F.array_repeat(F.lit(False), a - b - 1), F.array(F.lit(True)))))


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4) -> DataFrame:
    """The documents with repeated lines dropped from text, and n_lines (before) and n_dropped. A text that loses nothing stays as it is."""
    drops = repeated_lines(docs, min_chars, batches).select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.size("drop").cast("long").alias("__n"), flags_of(F.col("drop")).alias("__drop"))
    rows = docs.withColumn("__id", F.coalesce("doc_id", F.lit(LAST))).withColumn("__row", text_row(F.col("text"))).join(drops.hint("merge"), ["__id", "__row"], "left")  # drops grow with the input: never broadcast
    kept = F.filter(text_lines(F.col("text")), lambda x, i: ~F.coalesce(F.get("__drop", i), F.lit(False)))
    n_lines = (F.octet_length(F.coalesce("text", F.lit(""))) - F.octet_length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1).cast("long")
    rows = rows.withColumn("n_lines", n_lines).withColumn("n_dropped", F.coalesce("__n", F.lit(0).cast("long")))
    return rows.withColumn("text", F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("__id", "__row", "__n", "__drop")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
owners AS (SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT l.doc_id, l.i, l.line, coalesce(o.owner <> l.doc_id, false) AS gone FROM lines l LEFT JOIN owners o ON l.k = o.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
