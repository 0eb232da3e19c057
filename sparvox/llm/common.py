"""Shared pieces of the text operators: intermediate tables, tokens and Arrow helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that part words.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir; only a local session may make its own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparvox-"))
        found = sc.getCheckpointDir()
    return f"{found.rstrip('/')}/sparvox-{sc.applicationId}"


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends here, and a lost executor costs only a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() or bucketed() made and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        if hasattr(table, "stored_as"):
            spark.sql(f"DROP TABLE IF EXISTS `{table.stored_as}`")
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """Like stored, but as a table bucketed and sorted by keys: joins and cogroups by them read it in place, without a shuffle.

    The files lie in the shared folder; only the entry in the catalog is the session's."""
    spark = df.sparkSession
    name = f"{_prefix(spark)}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    table.stored_as, table.stored_at = name, path
    return table


def _prefix(spark: SparkSession) -> str:
    return "sparvox_" + "".join(c if c.isalnum() else "_" for c in spark.sparkContext.applicationId).lower()


def release(spark: SparkSession) -> None:
    """Have the driver let go of DataFrames that are out of use: Spark deletes a shuffle's files once nothing can read them.
    The scheduler holds on to a job until the next one, so there is one."""
    gc.collect()
    spark.range(1).count()
    spark._jvm.System.gc()


def clear_stored(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; call it once the results are written."""
    for table in spark.catalog.listTables():
        if table.name.startswith(_prefix(spark)):
            spark.sql(f"DROP TABLE IF EXISTS `{table.name}`")
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def training_row(mod: int):
    """True where crc32 of doc_id as text leaves a remainder other than 0 by mod; a null doc_id counts as the text ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod != 0


def large_strings(column: pa.Array) -> pa.Array:
    """The column as 64-bit-offset strings, null as empty, in memory of its own: pyarrow's string kernels misread a cast slice,
    whose first offset is not 0."""
    return pc.fill_null(pa.concat_arrays([column.cast(pa.large_string()), pa.array([], pa.large_string())]), "")


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, and the count of words of each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = pc.list_flatten(parts)
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.all(full).as_py() is not False:
        return flat, pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    keep = full.to_numpy(zero_copy_only=False).astype(bool)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    return flat.filter(full), np.bincount(owner[keep], minlength=len(texts)).astype(np.int64)


def slices(table: pa.RecordBatch, text: str, limit: int = 8 << 20):
    """Cut a record batch into runs of rows with about limit bytes of text, to bound what one step holds."""
    sizes = pc.fill_null(pc.binary_length(table.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *edges], [*edges, table.num_rows], strict=True):
        if b > a:
            yield table.slice(a, b - a)
