"""SimHash near-duplicates: fingerprints, pigeonhole candidate blocks, links and their components.

Defined results: a null text counts as empty and has fingerprint 0; rows with a null doc_id take part,
but a component's id is the smallest doc_id that is not null (null if there is none); repeated rows give
repeated results. Other columns of the input are ignored, so their names can't clash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, large_strings, release, stored

BITS = 64
SEED = 42
LAST = (1 << 63) - 1


def fingerprint(text: bytes, shingle: int = 3, step: int = 1 << 16) -> int:
    """The SimHash of a text's word shingles, repeats included; step bounds the shingles held at once."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - np.array([len(w) for w in words])
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1 :]
    set_bits = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, step):
        some = slice(at, min(n, at + step))
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[some].tolist(), ends[some].tolist(), strict=True)], ">u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big", signed=True)


def text_key(text):
    """Tells texts under one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_key, fp) of every document; fp is the unsigned fingerprint's bits as a BIGINT."""

    def run(batches):
        for batch in batches:
            texts = large_strings(batch.column(1))
            fps = [fingerprint(t.as_buffer().to_pybytes(), shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], ["doc_id", "text_key", "fp"])

    return docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key")).mapInArrow(run, "doc_id long, text_key long, fp long")


def block_masks(max_bits: int, spare: int = 3) -> list[int]:
    """Masks of every choice of spare blocks out of max_bits + spare: two fingerprints that differ in max_bits bits or fewer
    agree on at least one mask. Three spare blocks leave keys of about 32 bits for 3 differing bits, so that chance matches
    stay rare for billions of fingerprints."""
    n = max_bits + spare
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(x) for x in combinations(blocks, spare)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def spare_blocks(n: int, max_bits: int) -> int:
    """How many blocks the keys of n fingerprints are made of: three, or more where chance would let a fingerprint meet another one on a
    key. Longer keys take more masks, and find the same pairs."""
    spare = 3
    while n > 2.0 ** (BITS * spare / (max_bits + spare) + 1):
        spare += 1
    return spare


def links(nodes: DataFrame, max_bits: int = 3, spare: int | None = None) -> DataFrame:
    """(a, b, bits), a < b: all pairs of distinct fingerprints (column fp) that differ in max_bits bits or fewer, each pair once:
    at the first mask on which it agrees."""
    spare = spare_blocks(nodes.count(), max_bits) if spare is None else spare
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(max_bits, spare)])
    keyed = nodes.select("fp", F.posexplode(masks).alias("block", "mask")).select("block", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    a, b = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.array_position(F.transform(masks, lambda m: differ.bitwiseAND(m) == 0), F.lit(True)) - 1 == F.col("block")
    pairs = a.join(b, ["block", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= max_bits) & first)
    return pairs.select("a", "b", F.bit_count(differ).alias("bits"))


def shingle_sets(texts: DataFrame, words: int = 5) -> DataFrame:
    """texts (fp, text) to (fp, grams): the sorted distinct hashes of a text's word shingles, as bytes."""

    def run(batches):
        for batch in batches:
            found = []
            for t in large_strings(batch.column(1)):
                w = t.as_buffer().to_pybytes().lower().split()
                grams = {xxhash.xxh64_intdigest(b" ".join(w[i : i + words])) for i in range(max(1, len(w) - words + 1))}
                found.append(np.sort(np.fromiter(grams, np.uint64, len(grams))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["fp", "grams"])

    return texts.select("fp", "text").mapInArrow(run, "fp long, grams binary")


def similar(pairs: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b, ga, gb), those (a, b) whose sets have at least this Jaccard similarity."""

    def run(batches):
        for batch in batches:
            keep = []
            for ga, gb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(g.as_buffer(), np.uint64) for g in (ga, gb))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "ga", "gb").mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float, words: int) -> DataFrame:
    """Of pairs (a, b) of fingerprints, those whose first documents have similar word shingles. Only texts in pairs are compared."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(nodes, "fp").select("fp", F.col("first.id").alias("__id"), F.col("first.text_key").alias("__key"))
    texts = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("__id"), text_key(F.col("text")).alias("__key"), "text")
    sets = stored(shingle_sets(texts.join(need.hint("merge"), ["__id", "__key"]), words).dropDuplicates(["fp"]))  # need grows with the input: never broadcast
    both = pairs.join(sets.withColumnsRenamed({"fp": "a", "grams": "ga"}), "a").join(sets.withColumnsRenamed({"fp": "b", "grams": "gb"}), "b")
    return similar(both, similarity)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component, by alternating large and small stars.

    Every round is a table in the shared folder. The number of rounds grows with the logarithm of the longest chain."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(now)


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, verified_bits: int | None = None, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """(doc_id, text_key, fp, component_id, links): links counts the other distinct fingerprints that are linked.

    Fingerprints within max_bits bits are linked. With verified_bits, so are those within that many bits whose texts have a Jaccard
    similarity of at least `similarity` of their shingles of `words` words. Copies share a fingerprint, so a group of copies of any
    size is one node, and the pair search never sees it twice."""
    fps = stored(fingerprints(docs, shingle))
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "text_key"))
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), first.alias("first")))
    found = stored(links(nodes, max(max_bits, verified_bits or 0)))
    pairs = found.where(F.col("bits") <= max_bits).select("a", "b")
    if verified_bits is not None and verified_bits > max_bits:
        pairs = stored(pairs.unionByName(verified(docs, nodes, found.where(F.col("bits") > max_bits).select("a", "b"), similarity, words)))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    rooted = nodes.join(components(pairs).withColumnRenamed("node", "fp"), "fp", "left").join(degree, "fp", "left")
    rooted = stored(rooted.select("fp", "first_id", F.coalesce("root", "fp").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id", "links")
    return fps.join(classes, "fp").select("doc_id", "text_key", "fp", "component_id", "links")


def shingle_hashes(text: bytes, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles, as in shingle_sets, with the bits of a BIGINT."""
    w = text.lower().split()
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1 if w else np.zeros(1, np.int64)
    starts = ends - np.array([len(x) for x in w]) if w else np.zeros(1, np.int64)
    ends = ends[min(words, len(ends)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[i:j]) for i, j in zip(starts.tolist(), ends.tolist())], np.uint64).view(np.int64))


def sketch(grams: np.ndarray) -> bytes:
    """A bit for each remainder of the hashes by a power of two, from 64 bits and as many as there are hashes on: whether an odd number of hashes has it."""
    size = 1 << max(6, (len(grams) - 1).bit_length())
    return np.packbits(np.bincount(grams & (size - 1), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """How many hashes at least are in one set alone, by the bytes of both sketches. A longer sketch is folded to the size of the shorter."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def possibly_similar(pairs: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b, na, nb, sa, sb), with sizes and sketches, those (a, b) whose sets may have at least this Jaccard similarity: no such pair is
    lost, and of pairs that have a few shingles in common by chance next to none stay."""

    def run(batches):
        for batch in batches:
            keep = []
            for n, sa, sb in zip((batch.column(2).to_numpy() + batch.column(3).to_numpy()).tolist(), batch.column(4), batch.column(5), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint8) for s in (sa, sb))
                keep.append(apart(x, y) <= n * ((1 - similarity) / (1 + similarity)) + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def frequent_shingles(docs: DataFrame, words: int, sample: int = 20_000, most: int = 200_000) -> np.ndarray:
    """Hashes of shingles that several of about `sample` texts hold, the most frequent first. They only order the shingles of `prefixes`: any list gives the same pairs."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64(F.lit(9), text_key(F.col("text"))), F.lit(1 << 20)) < int(min(1.0, sample / max(n, 1)) * (1 << 20)))

    def run(batches):
        for batch in batches:
            for t in large_strings(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t.as_buffer().to_pybytes(), words))], ["token"])

    held = some.select("text").mapInArrow(run, "token long").groupBy("token").count().where("count > 2").orderBy(F.desc("count"), "token").limit(most)
    return np.array([r["token"] for r in held.select("token").collect()], np.int64)


def prefixes(docs: DataFrame, similarity: float, words: int) -> DataFrame:
    """(text_key, n, sketch, tokens) of every distinct text: of its n shingles, in one order for all texts (frequent ones last), so many of the
    first that two texts of at least this Jaccard similarity have one of them in common."""
    frequent = frequent_shingles(docs, words)
    place = np.argsort(frequent)  # how frequent: the place in the list
    frequent = frequent[place]

    def run(batches):
        for batch in batches:
            ns, sketches, tokens = [], [], []
            for t in large_strings(batch.column(0)):
                grams = shingle_hashes(t.as_buffer().to_pybytes(), words)
                at = np.minimum(np.searchsorted(frequent, grams), max(len(frequent) - 1, 0))
                last = frequent[at] == grams if len(frequent) else np.zeros(len(grams), bool)
                n = len(grams)
                ns.append(n)
                sketches.append(sketch(grams))
                common = grams[last][np.argsort(-place[at[last]])]
                tokens.append(np.concatenate([grams[~last], common])[: n - int(np.ceil(similarity * n - 1e-6)) + 1])
            columns = [batch.column(1), pa.array(ns, pa.int32()), pa.array(sketches, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["text_key", "n", "sketch", "tokens"])

    found = docs.select("text", text_key(F.col("text")).alias("text_key")).mapInArrow(run, "text_key long, n int, sketch binary, tokens array<long>")
    return found.dropDuplicates(["text_key"])


#: Of (doc_id, text_key): the smallest doc_id comes first, null last.
PLACE = "struct(doc_id IS NULL AS none, doc_id, text_key)"
KEYS = ["__none", "__id", "__key"]


def _keys(none, doc_id, key) -> list:
    return [none.alias("__none"), F.coalesce(doc_id, F.lit(0)).alias("__id"), key.alias("__key")]


def _part(key):
    """One of 2^20 parts of all texts: so many rows, of a number each, a table of them has at most."""
    return F.pmod(key, F.lit(1 << 20))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("*", *_keys(F.col("doc_id").isNull(), F.col("doc_id"), text_key(F.col("text"))))


def near_classes(docs: DataFrame, shingle: int = 3, max_bits: int = 3, similarity: float = 0.8, words: int = 5) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, fp) of every document, and (fp, root) of every fingerprint: the components of all pairs of fingerprints within max_bits bits and all pairs of texts whose
    shingles of `words` words have a Jaccard similarity of at least `similarity`, whatever their fingerprints.

    The latter come from a prefix-filter join, which misses none. First every text of a prefix shingle is compared with three others of
    it, which joins groups of near copies without their square; then all pairs that are not in one component by then. The number of pairs with
    a shingle in common by chance grows faster than the input, so they meet by their sketches, and only the texts of pairs that
    pass are moved. Tables and shuffles go as soon as they are out of use, so that the disk holds one step's."""
    spark = docs.sparkSession
    fps = stored(fingerprints(docs, shingle))
    nodes = fps.select("fp").distinct()
    close = stored(links(nodes, max_bits).select("a", "b"))
    fp_of = fps.groupBy("text_key").agg(F.min("fp").alias("fp"))
    first_of = fps.groupBy("text_key").agg(F.expr(f"min({PLACE})").alias("first"))  # one row of each text, so that copies of a text are not moved

    def possible(n1, at1, n2, at2):  # at the first shingle in common, the rest bounds how many there can be
        return F.least(n1 - at1, n2 - at2) >= (n1 + n2) * (similarity / (1 + similarity)) - 1e-6

    first_of_each = stored(prefixes(docs, similarity, words))
    sketches = stored(first_of_each.select("text_key", "n", "sketch"))
    release(spark)
    rows = first_of_each.select("text_key", "n", F.posexplode("tokens").alias("at", "token"))
    here, by_token = F.struct("at", "n", "text_key"), Window.partitionBy("token")
    # The text that has a shingle earliest has few of its own, so it is near to most of a group of near copies.
    others = F.array(F.min(here).over(by_token), F.lag(here, 1).over(by_token.orderBy("at", "n", "text_key")), F.lag(here).over(by_token.orderBy("n", "text_key")))
    shared = stored(rows.withColumn("others", others).withColumn("m", F.count("*").over(by_token)).where("m > 1").drop("m"))
    discard(first_of_each)
    release(spark)

    def ordered(pairs):
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    tried = shared.select("text_key", "n", "at", F.explode("others").alias("o")).where(F.col("o.text_key") != F.col("text_key"))
    tried = tried.where(possible(F.col("n"), F.col("at"), F.col("o.n"), F.col("o.at")))
    tried = stored(ordered(tried.select(F.col("text_key").alias("x"), F.col("o.text_key").alias("y"))))

    def kept(pairs):
        """Of pairs of text keys, the pairs of fingerprints whose texts are similar; only texts of pairs that their sketches allow are compared."""
        for side in "ab":
            pairs = pairs.join(sketches.withColumnsRenamed({"text_key": side, "n": f"n{side}", "sketch": f"s{side}"}).hint("merge"), side)
        pairs = stored(possibly_similar(pairs, similarity))
        release(spark)
        need = pairs.select(F.explode(F.array("a", "b")).alias("text_key")).distinct().hint("merge")  # grows with the input: never broadcast
        of = stored(first_of.join(need, "text_key").select(*_keys(F.col("first.none"), F.col("first.doc_id"), F.col("text_key"))))
        some = F.broadcast(of.select(_part(F.col("__key")).alias("__part")).distinct())  # keeps most of the other texts from being moved
        texts = _keyed(docs.select("doc_id", "text")).join(some, _part(F.col("__key")) == F.col("__part"), "left_semi")
        texts = texts.join(of.hint("merge"), KEYS, "left_semi").select(F.col("__key").alias("fp"), "text").dropDuplicates(["fp"])
        sets = stored(shingle_sets(texts, words))
        release(spark)
        both = pairs.join(sets.withColumnsRenamed({"fp": "a", "grams": "ga"}).hint("merge"), "a").join(sets.withColumnsRenamed({"fp": "b", "grams": "gb"}).hint("merge"), "b")
        found = similar(both, similarity)
        found = found.join(fp_of.withColumnsRenamed({"text_key": "a", "fp": "fa"}).hint("merge"), "a").join(fp_of.withColumnsRenamed({"text_key": "b", "fp": "fb"}).hint("merge"), "b")
        found = stored(found.where("fa <> fb").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).distinct())
        discard(pairs, of, sets)
        release(spark)
        return found

    edges = close.unionByName(met := kept(tried)).distinct()
    root = fp_of.join(components(edges).withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("text_key", F.coalesce("root", "fp").alias("root"))
    # The smaller text of a pair has its first common shingle early: the others of its prefix need no partner that is larger.
    parted = stored(shared.select("token", "text_key", "n", "at").join(root.hint("merge"), "text_key"))
    discard(shared)
    release(spark)
    early = parted.where(F.col("at") <= F.col("n") * ((1 - similarity) / (1 + similarity)) + 1e-6)
    one, two = (x.select("token", F.col("text_key").alias(f"k{i}"), F.col("n").alias(f"n{i}"), F.col("at").alias(f"at{i}"), F.col("root").alias(f"r{i}")) for i, x in ((1, early), (2, parted)))
    ahead = (F.col("r1") != F.col("r2")) & (F.struct("n1", "k1") < F.struct("n2", "k2"))
    left = one.hint("merge").join(two, (one["token"] == two["token"]) & ahead & possible(F.col("n1"), F.col("at1"), F.col("n2"), F.col("at2")))
    left = ordered(left.select(F.col("k1").alias("x"), F.col("k2").alias("y")))
    left = stored(left.join(tried.hint("merge"), ["a", "b"], "left_anti"))
    discard(parted, tried)
    release(spark)
    edges = stored(edges.unionByName(late := kept(left)).distinct())
    roots = stored(nodes.join(components(edges).withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))
    discard(sketches, left, close, met, late, edges)
    release(spark)
    return fps, roots


def near_copies(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text_key, fp, component_id) of every document, by near_classes."""
    fps, roots = near_classes(docs, **options)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("id")).join(roots.hint("merge"), "fp").groupBy("root").agg(F.min("id").alias("component_id"))
    return fps.join(roots.join(least.hint("merge"), "root").select("fp", "component_id").hint("merge"), "fp").select("doc_id", "text_key", "fp", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component of near_classes: that of the smallest doc_id (null last), and of its texts the one of the
    smallest key. Rows that share a doc_id are told apart by their texts; of rows equal in both, one is kept, whichever."""
    fps, roots = near_classes(docs, **options)
    first = fps.groupBy("fp").agg(F.expr(f"min({PLACE})").alias("first")).join(roots.hint("merge"), "fp").groupBy("root").agg(F.min("first").alias("first"))
    keep = first.select(*_keys(F.col("first.none"), F.col("first.doc_id"), F.col("first.text_key")))
    # Equal rows meet before the shuffle, so that they are no hot key; the join finds the rows where the first step put them.
    return _keyed(docs).dropDuplicates(KEYS).join(keep.hint("merge"), KEYS, "left_semi").select(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "links")
