"""Media columns: payloads cut by content, stored once per chunk, and rebuilt and verified from ordered chunk lists.

The media form is a WAV file of 8-bit mono samples. A rolling gear hash cuts it; every chunk has a SHA-256 digest. Executors
write compressed chunks to a store table, each digest once per task; the store is bucketed by digest, so the joins that pick
one stored copy of each digest for all documents read it in place. Documents keep the media's digest and the ordered list of
chunk digests. Reading back takes only stored bytes: every medium is assembled from its list, once per distinct medium. Data
are moved once, from digests to media. Chunks are compressed with a dictionary that is trained on a bounded sample of texts and
stored beside them; it changes only how many bytes the store takes.

Defined results: a null text is an empty payload of 64 zero bytes; null doc_ids and repeated rows pass through; an empty table
gives no rows. A text of any length is cut whole, and one medium is held in memory at a time. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, documents, large_strings, release, slices, stored

#: Chunk sizes of the store, set to texts of 1.5 kB: least bytes, bits of the gear hash (2 kB on average above the least), most bytes.
SIZES = (512, 11, 16 << 10)
RATE = 8000
HEADER = 44
#: One pseudo-random 32-bit number for each byte value, by rule: the first bytes of its SHA-256.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "big") for b in range(256)], np.uint32)


def wav(payload: bytes) -> bytes:
    """A WAV file whose 8-bit mono samples are the payload (of even length)."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(media: bytes) -> bytes:
    """The samples of such a file, by its own header."""
    riff, size, kind, fmt, _, code, channels, _, _, _, bits, data, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:HEADER])
    if (riff, kind, fmt, data, code, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or n != len(media) - HEADER or size != n + 36:
        raise ValueError("not a WAV file of 8-bit mono samples")
    return media[HEADER:]


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw + bytes(-len(raw) % unit or (0 if raw else unit))


def cuts(data: bytes, least: int = 16 << 10, bits: int = 14, most: int = 128 << 10) -> list[int]:
    """Ends of content-defined chunks: after a byte at which the gear hash of the last 32 bytes has its top bits zero,
    but least to most bytes from the cut before."""
    if len(data) <= least:
        return [len(data)]
    h = GEAR[np.frombuffer(data, np.uint8)]
    for shift in (1, 2, 4, 8, 16):  # the hash of 2m bytes is that of the last m plus the earlier m's, shifted
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    at = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    ends, begin = [], 0
    while len(data) - begin > least:
        i = np.searchsorted(at, begin + least)
        end = min(int(at[i]) if i < len(at) else len(data), begin + most, len(data))
        ends.append(end)
        begin = end
    if begin < len(data):
        ends.append(len(data))
    return ends


def feature(payload: bytes) -> str:
    """Statistics of the samples around their middle: mean, root mean square, zero crossings and peak."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"mean={x.mean():.4f};rms={float(np.sqrt((x * x).mean())):.4f};crossings={crossings};peak={int(np.abs(x).max())}"


def trained(docs: DataFrame, sample: int = 1000, chars: int = 10_000, size: int = 110 << 10) -> bytes:
    """A zstandard dictionary from the first `chars` of at most `sample` texts, the same ones on every run; empty if they are too few."""
    share = min(1.0, 4 * sample / max(docs.count(), 1))  # so few rows go to the driver at any size
    some = docs.where("length(text) > 0").select(F.substring("text", 1, chars).alias("text"), F.xxhash64("doc_id", "text").alias("at"))
    rows = some.where(F.shiftrightunsigned("at", 44) < share * (1 << 20)).orderBy("at").limit(sample).collect()
    texts = [r["text"].encode() for r in rows]
    return zstandard.train_dictionary(min(size, sum(map(len, texts)) // 8), texts).as_bytes() if len(texts) >= 100 and sum(map(len, texts)) > 1 << 16 else b""


def landed(docs: DataFrame, dictionary: bytes = b"", level: int = 15) -> DataFrame:
    """A table of two kinds of rows: documents (doc_id, n_bytes, media, chunks: ordered digests) and chunks (segment, data).
    segment: where it was written, the task and a number; a task writes a digest once. place is a chunk's digest, or deals a document out."""

    def run(batches):
        from pyspark import TaskContext

        segment, seen = TaskContext.get().partitionId() << 32, set()
        pack = zstandard.ZstdCompressor(level=level, **_with(dictionary))
        for big in batches:
            for batch in slices(big, "text", 4 << 20):
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), large_strings(batch.column(1)), strict=True):
                    raw = text.as_buffer().to_pybytes()
                    media = wav(padded(raw))
                    ends, begin, digests = cuts(media, *SIZES), 0, []
                    for end in ends:
                        chunk = media[begin:end]
                        begin = end
                        digests.append(digest := hashlib.sha256(chunk).digest())
                        if (key := digest[:16]) not in seen:
                            if len(seen) > 1_000_000:  # bounded memory: a digest may then be written again, and is still picked once
                                seen.clear()
                            seen.add(key)
                            segment += 1
                            rows.append((digest, None, None, None, None, segment, pack.compress(chunk)))
                    segment += 1
                    rows.append((segment.to_bytes(8, "big"), doc_id, len(raw), digests[0] if len(ends) == 1 else hashlib.sha256(media).digest(), digests, None, None))
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in LANDED.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, LANDED)


LANDED = "place binary, doc_id long, n_bytes long, media binary, chunks array<binary>, segment long, data binary"


def _with(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


READ = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read_back(media: bytes, digest: bytes) -> tuple:
    if hashlib.sha256(media).digest() != digest:
        raise ValueError("stored bytes do not match the digest of the medium")
    payload = samples(media)
    return digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), digest.hex(), feature(payload)


def _emit(rows: list) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in READ.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def assemble(parts: DataFrame, dictionary: bytes = b"") -> DataFrame:
    """Rebuild media from parts (media, n, seq, data): rows of a medium meet in one task in the order of seq, and one medium is held at
    a time. The only part of a medium is with itself where it is, so it is not moved."""

    def run(batches):
        unpack, at, held = zstandard.ZstdDecompressor(**_with(dictionary)), None, []
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != at and held:
                    rows.append(_read_back(b"".join(held), at))
                    held = []
                at = key
                held.append(unpack.decompress(data))
            yield _emit(rows)
        if held:
            yield _emit([_read_back(b"".join(held), at)])

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alone, more = (parts.where(x).select("media", "seq", "data") for x in ("n = 1", "n > 1"))
    return alone.mapInArrow(run, READ).unionByName(more.repartition(n, "media").sortWithinPartitions("media", "seq").mapInArrow(run, READ))


def media_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_chunks, ...): what is read back of each document's medium. The store stays in the shared folder."""
    spark, dictionary = docs.sparkSession, trained(docs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    beside = spark.createDataFrame([(hashlib.sha256(dictionary).digest(), None, None, None, None, 0, dictionary)], LANDED)
    land = bucketed(landed(docs, dictionary).unionByName(beside), n, "place")
    refs = land.where("media IS NOT NULL").select("doc_id", "n_bytes", "media", "chunks")
    store = land.where("segment IS NOT NULL").select("place", "segment", "data")
    # Chunks meet their lists by digest. The index of digests picks one stored copy of each; segment <= kept holds for that one alone.
    index = store.groupBy("place").agg(F.min("segment").alias("kept"))
    single = store.join(index.hint("merge"), "place").where("segment <= kept").select("place", "data")
    lists = refs.groupBy("media").agg(F.first("chunks").alias("chunks"))
    wanted = lists.select("media", F.size("chunks").alias("n"), F.posexplode("chunks").alias("seq", "place"))
    read = stored(assemble(single.join(wanted.hint("merge"), "place"), dictionary))
    release(spark)
    return refs.select("doc_id", "n_bytes", "media", F.size("chunks").alias("n_chunks")).join(read, "media").drop("media")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir).select("doc_id", "text"))
