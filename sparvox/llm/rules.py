"""Quality rules learnt: gradient-boosted trees over document statistics, flattened to arrays, with monotonic constraints.

Statistics are whole-table and exact; the trees are fitted on a bounded sample of labelled rows (`sample` rows of each
label). Counts that only ever speak against a text (share of symbols, of repeated words, of repeated lines) may only lower
its score.

Defined results: a null text has no words and is no line; it fails the base rule. Without enough labels the verdict is true,
so that only the base rules decide. null doc_ids and repeated rows are treated like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, large_strings, slices, split_words, stored, training_row

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_stops", "n_distinct")


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(ids: np.ndarray, row: np.ndarray, n_ids: int) -> np.ndarray:
    """Marks words that lie in a window of three words found twice or more in their row."""
    marked = np.zeros(len(ids), bool)
    if len(ids) < 3:
        return marked
    inside = row[:-2] == row[2:]
    if n_ids < 1 << 21:
        code = (ids[:-2].astype(np.int64) << 42) | (ids[1:-1].astype(np.int64) << 21) | ids[2:]
    else:
        pair = np.unique(ids[:-2].astype(np.int64) * n_ids + ids[1:-1], return_inverse=True)[1]
        code = pair.astype(np.int64) * n_ids + ids[2:]
    order = np.argsort(code, kind="stable")  # rows stay in order within a code, so equal windows of a row are neighbours
    order = order[inside[order]]
    same = (code[order][1:] == code[order][:-1]) & (row[order][1:] == row[order][:-1])
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    at = order[hit]
    for k in range(3):
        marked[at + k] = True
    return marked


def batch_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    words, n_words = split_words(texts, lower=False)
    offsets = np.concatenate([[0], np.cumsum(n_words)])
    row = np.repeat(np.arange(len(n_words)), n_words)
    coded = pc.dictionary_encode(words)
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    chars = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)
    out = {"n_words": n_words, "word_chars": _per_row(chars[ids] if len(ids) else np.zeros(0, np.int64), offsets)}
    buffers, at = texts.buffers(), texts.offset
    ends = np.frombuffer(buffers[1], np.int64)[at : at + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]] if buffers[2] else np.zeros(0, np.uint8)
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    out["n_symbols"] = _per_row(table[raw], ends - ends[0])
    out["n_upper"] = _per_row((raw >= 65) & (raw <= 90), ends - ends[0])
    out["n_stops"] = _per_row((raw == 46) | (raw == 44), ends - ends[0])
    dup = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        lines = text.as_buffer().to_pybytes().split(b"\n")
        if len(lines) > 1:
            full = [x for x in lines if x.split(None, 1)]
            dup[i] = len(full) - len(set(full))
    out["n_dup_lines"] = dup
    out["n_repeat_words"] = _per_row(_repeats(ids, row, len(coded.dictionary)), offsets)
    pairs = np.unique(row * max(1, len(coded.dictionary)) + ids) // max(1, len(coded.dictionary))
    out["n_distinct"] = np.bincount(pairs, minlength=len(texts)).astype(np.int64)
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, ...STATS) of every whole text."""

    def run(batches):
        for big in batches:
            for batch in slices(big, "text"):
                found = batch_stats(large_strings(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(found[k].astype(np.int64)) for k in STATS]], ["doc_id", *STATS])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in STATS))


FEATURES = ("log_words", "chars_per_word", "symbols", "dup_lines", "repeats", "upper", "stops", "distinct")
#: -1: the score may only fall as the feature grows.
MONOTONIC = {"symbols": -1, "dup_lines": -1, "repeats": -1}


def features(s) -> np.ndarray:
    """A row of FEATURES for each row of statistics (a mapping from names to arrays)."""
    n, c = np.maximum(s["n_words"], 1).astype(float), np.maximum(s["word_chars"], 1).astype(float)
    cols = [np.log1p(s["n_words"]), c / n, s["n_symbols"] / c, s["n_dup_lines"] / n, s["n_repeat_words"] / n, s["n_upper"] / c, s["n_stops"] / n, s["n_distinct"] / n]
    return np.column_stack([np.asarray(x, float) for x in cols])


@dataclass(frozen=True)
class Trees:
    """All trees' nodes in flat arrays: a leaf's children are itself."""

    roots: np.ndarray
    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.split[at], self.left[at], self.right[at])
            out += self.value[at]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss on binned features. A split on a constrained feature must order its children's
    values, and all that lies below stays on its side of their middle, so that whole trees are monotonic."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    p0 = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    base = float(np.log(p0 / (1 - p0)))
    score, nodes, roots = np.full(len(y), base), [], []

    def grow(rows, g, h, low, high, level):
        at = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
        nodes.append([0, 0.0, at, at, rate * value])
        best = None
        if level < depth and len(rows) > 1:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for f in range(x.shape[1]):
                n = len(edges[f]) + 1
                lg, lh = np.cumsum(np.bincount(code[rows, f], g[rows], n))[:-1], np.cumsum(np.bincount(code[rows, f], h[rows], n))[:-1]
                rg, rh = total_g - lg, total_h - lh
                gain = lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - total_g**2 / (total_h + ridge)
                a, b = np.clip(-lg / (lh + ridge), low, high), np.clip(-rg / (rh + ridge), low, high)
                ok = (lh >= least) & (rh >= least) & (signs[f] * (b - a) >= 0)
                gain = np.where(ok, gain, 0)
                if len(gain) and gain.max() > (best[0] if best else 1e-6):
                    k = int(gain.argmax())
                    best = (float(gain[k]), f, k, float(a[k]), float(b[k]))
        if best:
            _, f, k, a, b = best
            mid = (a + b) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(signs[f])]
            goes = code[rows, f] <= k
            nodes[at][:2] = [f, float(edges[f][k])]
            nodes[at][2] = grow(rows[goes], g, h, *bounds[0], level + 1)
            nodes[at][3] = grow(rows[~goes], g, h, *bounds[1], level + 1)
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), -8.0, 8.0, 0))
        one = _flat(nodes[first:], [0], 0.0, depth, first)
        score += one.margin(x)
    return _flat(nodes, roots, base, depth, 0)


def _flat(nodes: list, roots: list, base: float, depth: int, shift: int) -> Trees:
    f, s, left, right, v = map(np.array, zip(*nodes, strict=True)) if nodes else [np.zeros(0)] * 5
    return Trees(np.array(roots, int), f.astype(int), s.astype(float), left.astype(int) - shift, right.astype(int) - shift, v.astype(float), base, depth)


def fit(stats: DataFrame, labels: DataFrame, sample: int = 4000, mod: int = 5) -> Trees | None:
    """Trees from at most sample rows of each label whose crc32 remainder by mod is not 0; None with fewer than 16 of either."""
    marked = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(training_row(mod))
    rows = marked.withColumn("rank", F.xxhash64(F.lit(7), "doc_id"))
    chosen = rows.where("quality = 0").orderBy("rank").limit(sample).unionByName(rows.where("quality = 1").orderBy("rank").limit(sample))
    found = stats.join(F.broadcast(chosen), "doc_id").orderBy("rank", *STATS).limit(2 * sample).toPandas()
    y = found["quality"].to_numpy(float)
    if min((y == 0).sum(), (y == 1).sum()) < 16:
        return None
    return fit_trees(features(found), y, np.array([MONOTONIC.get(f, 0) for f in FEATURES]))


def judge(stats: DataFrame, model: Trees | None, threshold: float = 0.3) -> DataFrame:
    """stats with base_failed, score and kept."""

    def run(batches):
        for batch in batches:
            s = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in STATS}
            p = 1 / (1 + np.exp(-model.margin(features(s)))) if model and batch.num_rows else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, "score"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in STATS) + ", score double"
    scored = stats.select("doc_id", *STATS).mapInArrow(run, schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(statistics(documents(spark, sf_dir)))
    model = fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(stats, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
