"""Quality by compression: zstandard dictionaries of good and of bad text, and a calibrated score of the size difference.

Fitting takes a bounded sample of labelled rows (`sample` rows of each label, by a hash of doc_id, and `chars` of each text);
scoring reads every whole text. Half of the sample makes the dictionaries, the other half calibrates, so that dictionaries
never see what calibrates them.

Defined results: a null text is empty, and empty texts score by the calibration at difference 0; if the sample lacks a label,
every score is the sample's mean label (1 without labels); null doc_ids and repeated rows are scored like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, large_strings, slices, training_row

DICTIONARY_BYTES = 110 << 10


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    level: int = 3

    def scorer(self):
        if not self.good:
            return lambda raw: 1 / (1 + np.exp(-self.weights[0]))
        sizes = _sizer(self.good, self.bad, self.level)

        def score(raw: bytes) -> float:
            z = float(np.dot(self.weights, _inputs(*sizes(raw), len(raw))))
            return 1 / (1 + float(np.exp(min(-z, 700.0))))

        return score


def _sizer(good: bytes, bad: bytes, level: int):
    make = lambda d: zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False)
    a, b, c = make(good), make(bad), zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)
    return lambda raw: (len(a.compress(raw)), len(b.compress(raw)), len(c.compress(raw)))


def _inputs(good: int, bad: int, plain: int, n: int) -> np.ndarray:
    """1, the normalised difference of compressed sizes, the same weighted by length, and by how much the text alone
    compresses better than prose ever does: that of a text which repeats itself says more than either dictionary."""
    d = (bad - good) / (bad + good) if n else 0.0
    own = max(0.0, 0.35 - plain / n) if n else 0.0
    return np.array([1.0, d * 10, d * np.log1p(n), own * 10])


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 100) -> np.ndarray:
    """Logistic regression; the first column is the constant. Weights of the others, in units of their spread, are held down by
    `ridge`, so that labels which the inputs part without error have finite weights. Newton steps are halved until the loss falls."""
    spread = np.append(1.0, np.where((s := x[:, 1:].std(axis=0)) > 0, s, 1.0))
    x, hold = x / spread, ridge * np.append(1e-6, np.ones(x.shape[1] - 1))

    def loss(w):
        z = x @ w
        return np.logaddexp(0, np.where(y > 0, -z, z)).sum() + 0.5 * (hold * w * w).sum()

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (p - y) + hold * w)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-9:
            break
        w = w - size * step
    return w / spread


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, chars: int, mod: int = 5) -> list[tuple[bytes, int]]:
    """At most sample rows of each label (0 and 1) whose crc32 remainder by mod is not 0, the same ones on every run."""
    marked = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = marked.where(training_row(mod)).withColumn("rank", F.xxhash64(F.lit(5), "doc_id"))
    chosen = rows.where("quality = 0").orderBy("rank").limit(sample).unionByName(rows.where("quality = 1").orderBy("rank").limit(sample))
    found = docs.select("doc_id", F.coalesce(F.substring("text", 1, chars), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # The rank comes along so that the order is the same on every run.
    return [(r["text"].encode(), r["quality"]) for r in found.orderBy("rank", "text").limit(2 * sample).collect()]


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1500, chars: int = 20_000, level: int = 3) -> CompressionModel:
    rows = labelled_sample(docs, labels, sample, chars)
    by = {q: [t for t, y in rows if y == q and t] for q in (0, 1)}
    if min(map(len, by.values())) < 16:
        mean = np.mean([y for _, y in rows]) if rows else 1.0
        mean = float(np.clip(mean, 1e-6, 1 - 1e-6))
        return CompressionModel(b"", b"", (float(np.log(mean / (1 - mean))),), level)
    made = []
    for q in (1, 0):
        texts = by[q][::2]
        pieces = [t[i : i + 2000] for t in texts for i in range(0, len(t), 2000)]
        made.append(zstandard.train_dictionary(min(DICTIONARY_BYTES, max(4096, sum(map(len, pieces)) // 4)), pieces).as_bytes())
    sizes = _sizer(*made, level)
    rest = [(t, q) for q in (0, 1) for t in by[q][1::2]]
    x = np.array([_inputs(*sizes(t), len(t)) for t, _ in rest])
    return CompressionModel(*made, tuple(calibrate(x, np.array([q for _, q in rest], float))), level)


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """docs with a column score, 0 to 1. The model is a few hundred kB, whatever the input."""
    at = docs.columns.index("text")

    def run(batches):
        scorer = model.scorer()
        for big in batches:
            for batch in slices(big, "text"):
                found = [scorer(t.as_buffer().to_pybytes()) for t in large_strings(batch.column(at))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("score", DoubleType()))


def op5_quality(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (~training_row(5)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
