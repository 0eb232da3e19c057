"""Best-two-fit packing of token sequences.

Only the number of pieces of each length matters for a packing, and there are at most `capacity` lengths. So the driver
plans over that histogram: a bin is filled greedily, then its smallest piece is replaced by two unpacked ones that fill
the widened gap more tightly; a bin's pattern is used as often as the counts allow. Executors rank pieces within their
length and read their sequence and offset off the plan. The plan covers the whole table, so there are no leftovers of
partitions, and it stays as small for any number of documents.

Defined results: a null text is an empty one and gives a single piece with the end token; repeated rows are packed one
by one; a null doc_id is carried as it is. An empty table gives no rows; a text of any length is encoded whole and cut. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, large_strings, slices, stored

#: Of byte-level BPE: the printable stand-ins of bytes, as the vocabulary file spells them.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Encoder:
    """Token ids of the vocabulary in a tokenizers JSON file. The same byte-level BPE runs by its merge ranks several times faster than
    the library's own loop; texts that hold a special token's string go through the library itself."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rest = [b for b in range(256) if b not in set(_PRINTED)]
        byte_of = {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {bytes(byte_of[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.plain.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, capacity: int = 1024, end: int = 2, vocabulary: str = "byte_bpe_50k.json", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and the end token, cut into pieces of capacity ids; the first may be shorter."""

    def run(batches):
        for whole in batches:
            if vocabulary not in _encoders:
                _encoders[vocabulary] = Encoder(vocabulary_path(vocabulary))
            encode = _encoders[vocabulary]
            for batch in slices(whole, "text"):
                ids, rows = batch.column("doc_id").to_pylist(), []
                for doc_id, text in zip(ids, large_strings(batch.column("text")).to_pylist(), strict=True):
                    tokens = np.array([*encode(text), end], "<u4")
                    first = len(tokens) % capacity or capacity
                    start = 0
                    for i, stop in enumerate(range(first, len(tokens) + 1, capacity)):
                        raw = tokens[start:stop].tobytes()
                        rows.append((doc_id, i, start, stop - start, zlib.crc32(raw), *([raw] if with_ids else [])))
                        start = stop
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths with how many bins use each. counts[n]: pieces of length n, n from 1 to capacity."""
    left, plan = counts.astype(np.int64).copy(), []
    lengths = np.arange(capacity + 1)

    def largest(at_most: int, have: np.ndarray) -> int:
        found = np.flatnonzero(have[1 : at_most + 1] > 0)
        return int(found[-1]) + 1 if len(found) else 0

    top = capacity
    while (top := largest(top, left)) > 0:
        have, pattern, gap = left.copy(), [], capacity
        while gap > 0 and (n := largest(gap, have)):
            times = min(int(have[n]), gap // n)
            pattern += [n] * times
            have[n] -= times
            gap -= n * times
        while len(pattern) > 1 and gap > 0:  # two for the smallest; never for the first, which has to go somewhere
            small = pattern[-1]
            room = gap + small
            have[small] += 1
            ok = np.where(have > 0, lengths, 0)
            below = np.maximum.accumulate(ok)  # the largest length at hand that is not above an index
            a = np.flatnonzero(have[: room + 1] > 0)
            a = a[a > 0]
            b = below[room - a]
            b = np.where((b == a) & (have[a] < 2), below[np.maximum(a - 1, 0)], b)
            total = np.where(b > 0, a + b, 0)
            best = int(total.argmax()) if len(total) else 0
            if not len(total) or total[best] <= small:
                have[small] -= 1
                break
            x, y = int(a[best]), int(b[best])
            have[x] -= 1
            have[y] -= 1
            pattern = sorted([*pattern[:-1], x, y], reverse=True)
            gap = room - x - y
        used = np.bincount(pattern, minlength=capacity + 1)
        at = np.flatnonzero(used)
        times = int((left[at] // used[at]).min())
        left -= used * times
        plan.append((pattern, times))
    return plan


def plan_table(plan: list[tuple[list[int], int]]) -> pd.DataFrame:
    """A row for each slot of each pattern: pieces ranked first to last - 1 of a length go to sequences base, base + 1, ... at offset."""
    rows, ranks, base = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for n in pattern:
            first = ranks.get(n, 0)
            rows.append((n, first, first + times, base, offset))
            ranks[n] = first + times
            offset += n
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "last", "base", "offset"]).astype("int64")


def pack(table: DataFrame, capacity: int = 1024, deal: int = 64) -> DataFrame:
    """table (with length, doc_id, piece) gets sequence_id and offset. deal splits the ranking of each length, so that a length
    which a third of all pieces share is ranked by many tasks; it should grow with the cluster."""
    spark = table.sparkSession
    rows = table.withColumn("__deal", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(deal)).cast("int"))
    counts = stored(rows.groupBy("length", "__deal").agg(F.count("*").alias("n")))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most capacity rows
        histogram[length] = n
    plan = plan_table(plan_bins(histogram, capacity))
    before = W.partitionBy("length").orderBy("__deal").rowsBetween(W.unboundedPreceding, -1)
    lead = counts.select("length", "__deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__lead"))
    nth = F.row_number().over(W.partitionBy("length", "__deal").orderBy("doc_id", "piece")) - 1
    ranked = rows.withColumn("__nth", nth).join(F.broadcast(lead), ["length", "__deal"])  # at most capacity * deal rows
    ranked = ranked.withColumn("__rank", F.col("__lead") + F.col("__nth"))
    slots = spark.createDataFrame(plan, "length long, first long, last long, base long, offset long").withColumnRenamed("length", "__length")
    if len(plan) <= 1_000_000:
        slots = F.broadcast(slots)
    found = ranked.join(slots, (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("first")) & (F.col("__rank") < F.col("last")))
    return found.withColumn("sequence_id", F.col("base") + F.col("__rank") - F.col("first")).select(*table.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = 1024, end: int = 2, vocabulary: str = "byte_bpe_50k.json", with_ids: bool = False) -> DataFrame:
    return pack(stored(pieces(docs, capacity, end, vocabulary, with_ids)), capacity)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
