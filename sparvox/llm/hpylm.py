"""A hierarchical Pitman-Yor language model of word tokens, trained and applied without gathering the corpus anywhere.

Model: every pair of tokens that precedes a token has a restaurant of its own, whose dishes are tokens. Its parent is the
restaurant of the nearer token of the pair, shared by all pairs that end in it; the parent of those is one restaurant without
context, whose base is uniform over the known tokens and one for all unknown ones. The tables of a restaurant are its
parent's customers. The tokens before a document's first are ends.

Sampling: the first seating has one table a dish. A round then draws every dish's tables anew (blocked Gibbs) from their law
given all others as the round before left them: P(t) in proportion to S(c, t) * a ** t, c the customers, S the generalised
Stirling numbers of the discount, and a = (strength + discount * tables) * the parent's probability. Restaurants are sampled
side by side, so a is that of the round before. The seating is carried from round to round; rounds after burn-in are samples,
and predictive probabilities are averaged over them.

Data flow. Documents become chunks of token codes, one row each. Parts of the vocabulary, dealt out by hash, count the words
of all chunks and give them ids. A chunk then sends its distinct triples, with their counts, to blocks dealt out by the nearer
context token, so that a block holds whole restaurants and their parents; a token that is frequent has its triples dealt out by
both context tokens, and its dishes are summed in the parts, which also hold the restaurant without context. A round is two
exchanges: blocks send tables by dish, parts answer with probabilities. At last every block answers each chunk what it asked for.
The driver holds totals of the frequent tokens alone, at most 8 a block. All tables lie in the shared folder and draws are
seeded, so a lost task repeats itself.

Defined results: a null text is empty: one end token. A null doc_id counts as the text '' for the split. Repeated rows train
and score one by one. With no training rows every token is unknown. An empty table gives no rows. Texts of any length are
tokenised whole, and a chunk holds at least one. Other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, discard, documents, large_strings, release, slices, split_words, stored, training_row

#: Steps of log10 probabilities on their way from blocks to chunks: a token's is off by 4e-6 at most.
STEP = 1 << 17
#: Spark allows a table 100,000 buckets.
MOST_BUCKETS = 50_000
END = xxhash.xxh64_intdigest(b"\n") - (1 << 63)


def _planes(x, back: bool):
    """Arrays as all their first bytes, all their second ones and so on, which compress better than numbers; and back."""
    if isinstance(x, dict):
        return {k: _planes(v, back) for k, v in x.items()}
    if back and isinstance(x, tuple) and x and isinstance(x[0], str):
        return np.ascontiguousarray(x[2].T).reshape(-1).view(x[1])
    if isinstance(x, (list, tuple)):
        return type(x)(_planes(v, back) for v in x)
    if not back and isinstance(x, np.ndarray) and x.ndim == 1 and x.itemsize > 1:
        return "planes", x.dtype.str, np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T)
    return x


def _squeeze(x) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(_planes(x, False), protocol=5))


def _unsqueeze(x: bytes):
    return _planes(pickle.loads(zstandard.ZstdDecompressor().decompress(x)), True)


def _smallest(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _steps(x: np.ndarray) -> np.ndarray:
    """A rising array as steps, which take less room; np.cumsum undoes it."""
    return _smallest(np.diff(x, prepend=0))


def _sums(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, n, size).astype(np.int64)


def _distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted distinct rows of some columns of whole numbers from 0, and where each row stands among them."""
    bits = [int(c.max()).bit_length() if len(c) else 0 for c in columns]
    if sum(bits) < 64:
        key = np.zeros(len(columns[0]), np.int64)
        for c, b in zip(columns, bits, strict=True):
            key = key << b | c.astype(np.int64)
        key, where = np.unique(key, return_inverse=True)
        out = []
        for b in reversed(bits):
            out.append(key & ((1 << b) - 1))
            key = key >> b
        return out[::-1], where
    if len(columns) == 2:
        order = np.lexsort(columns[::-1])
        a, b = columns[0][order], columns[1][order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        where = np.empty(len(order), np.int64)
        where[order] = np.cumsum(new) - 1
        return [a[new], b[new]], where
    first, rest = _distinct(*columns[:2])  # number the first two columns together, and try again
    found, where = _distinct(rest, *columns[2:])
    return [first[0][found[0]], first[1][found[0]], *found[1:]], where


# ---- chunks and their vocabulary


def chunks(docs: DataFrame, held_out, chunk_tokens: int = 1 << 20) -> DataFrame:
    """(chunk, n_train, n_tokens, data): data has the tokens of whole documents as codes of the chunk's own list of words."""

    def made(part: int, n: int, held: list) -> tuple:
        doc_ids, flags = (sum((x[i] for x in held), []) for i in (0, 1))
        lengths = np.concatenate([x[3] for x in held])
        coded = pa.chunked_array([x[2] for x in held]).dictionary_encode().combine_chunks()
        spelt, codes = coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        often = np.argsort(-np.bincount(codes, minlength=len(spelt)), kind="stable")  # small codes for frequent words take less room
        code_of = np.empty(len(spelt), np.int64)
        code_of[often] = np.arange(len(spelt))
        hashes = np.array([*[xxhash.xxh64_intdigest(spelt[i]) - (1 << 63) for i in often.tolist()], END], np.int64)
        # The end token has the last code; it stands after each document's words.
        tokens = np.full(len(codes) + len(lengths), len(spelt), np.uint32)
        inner = np.ones(len(tokens), bool)
        inner[np.cumsum(lengths + 1) - 1] = False
        tokens[inner] = code_of[codes]
        held_ = np.array(flags, bool)
        data = _squeeze({"doc_ids": doc_ids, "held": held_, "lengths": lengths + 1, "tokens": _smallest(tokens), "hashes": hashes})
        return part << 32 | n, int((lengths + 1)[~held_].sum()), len(tokens), data

    def run(batches):
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

        def row(x):
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(x, kinds, strict=True)], ["chunk", "n_train", "n_tokens", "data"])

        for big in batches:
            for batch in slices(big, "text", 4 << 20):
                texts = large_strings(batch.column(1))
                held.append((batch.column(0).to_pylist(), batch.column(2).to_pylist(), *split_words(texts)))
                size += texts.nbytes
                if size >= chunk_tokens * 6:  # about so many bytes a token
                    yield row(made(part, n, held))
                    n, held, size = n + 1, [], 0
        if held:
            yield row(made(part, n, held))

    return docs.select("doc_id", "text", held_out.alias("held")).mapInArrow(run, "chunk long, n_train long, n_tokens long, data binary")


def _train(chunk: dict) -> np.ndarray:
    return np.repeat(~chunk["held"], chunk["lengths"])


def _by_part(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of words by part and hash, and where each part starts in it."""
    part = hashes % parts
    order = np.lexsort((hashes, part))
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def vocabulary(table: DataFrame, parts: int, hot: int) -> DataFrame:
    """(part, chunk, known, often, data). For each chunk and part: the ids and training counts of the chunk's words, in the order of
    _by_part; an id leaves the remainder part by parts. One row of each part has no chunk, the number of known words, and the ids and
    counts of words that stand more than `hot` times."""

    def sent(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chunk = _unsqueeze(data)
                n = _sums(chunk["tokens"][_train(chunk)], None, len(chunk["hashes"]))
                order, at = _by_part(chunk["hashes"], parts)
                rows = [(p, key, _squeeze((chunk["hashes"][order[a:b]], _smallest(n[order[a:b]])))) for p, (a, b) in enumerate(zip(at, at[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "chunk", "data"])

    def merged(group: pa.Table) -> pa.Table:
        part, keys = group.column("part")[0].as_py(), group.column("chunk").to_pylist()
        lists = [_unsqueeze(x) for x in group.column("data").to_pylist()]
        words, where = np.unique(np.concatenate([h for h, _ in lists]), return_inverse=True)
        c = _sums(where, np.concatenate([n for _, n in lists]), len(words))
        ids, at = np.empty(len(words), np.int64), np.cumsum([0, *[len(h) for h, _ in lists]])
        ids[np.argsort(-c, kind="stable")] = np.arange(len(words)) * parts + part  # small ids for frequent words
        often = [{"id": int(ids[i]), "n": int(c[i])} for i in np.flatnonzero(c > hot)]
        rows = [(part, None, int((c > 0).sum()), often, None)]
        rows += [(part, k, 0, [], _squeeze((_smallest(ids[where[a:b]]), _smallest(c[where[a:b]])))) for k, a, b in zip(keys, at, at[1:])]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())])), pa.binary()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "chunk", "known", "often", "data"])

    rows = table.select("chunk", "data").mapInArrow(sent, "part long, chunk long, data binary")
    return rows.repartition(parts, "part").groupBy("part").applyInArrow(merged, "part long, chunk long, known long, often array<struct<id: long, n: long>>, data binary")


def _named(chunk: dict, replies: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and training counts of a chunk's words, from the parts' replies (key: part, data)."""
    found = sorted(zip(replies.column("key").to_pylist(), replies.column("data").to_pylist(), strict=True))
    lists = [_unsqueeze(x) for _, x in found]
    order, _ = _by_part(chunk["hashes"], parts)
    ids, c = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    ids[order] = np.concatenate([x for x, _ in lists])
    c[order] = np.concatenate([x for _, x in lists])
    return ids, c


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that look random, of each whole number."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def triples(chunk: dict, ids: np.ndarray, model: dict) -> dict:
    """The chunk's distinct triples v (token before), u (the one before that) and w, by block and then by their ids; which tokens are
    which (where); and how often each stands in training rows (n)."""
    order = np.argsort(ids)
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    w, end = rank[chunk["tokens"]], rank[len(ids) - 1]
    starts = np.cumsum(chunk["lengths"]) - chunk["lengths"]
    v = np.append(end, w[:-1])  # the token before a document's first is the end of the one before it
    u = np.append(end, v[:-1])
    u[starts] = end
    if model["order"] == 2:
        u[:] = end
    (v, u, w), where = _distinct(v, u, w)
    v, u, w = (ids[order][x] for x in (v, u, w))
    n = _sums(where[_train(chunk)], None, len(w))
    hot = np.isin(v, model["hot"])
    block = (_mixed(np.where(hot, _mixed(v) ^ u.astype(np.uint64), v)) % np.uint64(model["blocks"])).astype(np.int64)
    turn = np.argsort(block, kind="stable")
    place = np.empty(len(turn), np.int64)
    place[turn] = np.arange(len(turn))
    return {"v": v[turn], "u": u[turn], "w": w[turn], "n": n[turn], "where": place[where], "at": np.searchsorted(block[turn], np.arange(model["blocks"] + 1))}


def _runs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where a new pair starts in rows sorted by pairs."""
    return np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, np.int64)


def requests(table: DataFrame, words: DataFrame, model: dict) -> DataFrame:
    """(block, chunk, data): each chunk's triples for each block, context by context."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for key, data in zip(left.column("chunk").to_pylist(), left.column("data").to_pylist(), strict=True):
            chunk = _unsqueeze(data)
            t = triples(chunk, _named(chunk, right, model["parts"])[0], model)
            for b, (i, j) in enumerate(zip(t["at"], t["at"][1:])):
                if j > i:
                    v, u, w, n = (t[k][i:j] for k in ("v", "u", "w", "n"))
                    first = _runs(v, u)
                    rows.append((b, key, _squeeze((_steps(v[first]), _smallest(u[first]), _steps(first), _smallest(w), _smallest(n)))))
        kinds = (pa.int64(), pa.int64(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "chunk", "data"])

    return table.select("chunk", "data").groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(run, "block long, chunk long, data binary")


# ---- seating


@lru_cache(maxsize=4)
def stirling(discount: float, most: int = 1024) -> np.ndarray:
    """[c, t]: logarithms of the generalised Stirling numbers S(c, t), by S(c + 1, t) = S(c, t - 1) + (c - discount * t) * S(c, t)."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0.0
    t = np.arange(1, most + 1)
    for c in range(1, most + 1):
        with np.errstate(divide="ignore", invalid="ignore"):
            more = np.where(t < c, np.log(np.maximum(c - 1 - discount * t, 1e-300)) + s[c - 1, 1:], -np.inf)
        s[c, 1:] = np.logaddexp(s[c - 1, :-1], more)
    return s


def seat(rng: np.random.Generator, c: np.ndarray, weight: np.ndarray, discount: float) -> np.ndarray:
    """Tables of each of many dishes with c customers, drawn from P(t) in proportion to S(c, t) * weight ** t.

    Up to 1,024 customers by the numbers themselves. Beyond, they are the coefficients of a compound Poisson law, which gives the mean
    and variance of t; where these agree, all tables but one are Poisson, else t is close to normal (tests hold it to the exact law)."""
    t = np.minimum(c, 1).astype(np.int64)
    if not len(c):
        return t
    numbers = stirling(discount)
    order = np.argsort(c, kind="stable")
    sizes, first = np.unique(c[order], return_index=True)
    for k, i, j in zip(sizes.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        if k < 2:
            continue
        if k >= len(numbers):
            at = order[i:]
            t[at] = _many(rng, c[at].astype(float), weight[at], discount)
            break
        base, span = numbers[k, 1 : k + 1], np.arange(1.0, k + 1)
        step = max(1, (1 << 20) // k)
        for a in range(i, j, step):
            at = order[a : min(j, a + step)]
            if k == 2:
                t[at] += rng.random(len(at)) * (weight[at] + 1 - discount) < weight[at]
                continue
            p = base + np.log(weight[at])[:, None] * span
            p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
            t[at] = 1 + (p < (rng.random(len(at)) * p[:, -1])[:, None]).sum(axis=1)
    return t


def _many(rng: np.random.Generator, c: np.ndarray, a: np.ndarray, discount: float) -> np.ndarray:
    # Tables come as a Poisson number of mean a * f(x), f(x) = (1 - y ** d) / d, y = 1 - x; x is such that c customers are expected.
    low, high = np.zeros(len(c)), np.ones(len(c))
    for _ in range(60):
        y = (low + high) / 2
        over = a * (1 - y) > c * y ** (1 - discount)
        low, high = np.where(over, y, low), np.where(over, high, y)
    mean = a * (1 - y**discount) / discount
    spread = mean - c * y / (y + (1 - y) * (1 - discount))
    poisson = 1 + rng.poisson(np.minimum(mean, 1e12))
    normal = np.rint(mean + 1 + np.sqrt(np.maximum(spread, 0)) * rng.standard_normal(len(c)))
    return np.clip(np.where(spread > 0.9 * mean, poisson, normal), 1, c).astype(np.int64)


# ---- blocks: the restaurants of two and of one token of context


def block_of(lists: list[tuple], model: dict) -> tuple[dict, list[np.ndarray], np.ndarray]:
    """The restaurants of a block from its chunks' triples; where the triples of each chunk stand; and the keys (part, hot, rank) of
    the dishes that are passed on: hot is 0 for a word, and 1 + a frequent token's place in the list for a word after it.

    Triples are sorted by v, u and w, pairs (dishes of v) by v and w; `outer` says which key a pair goes by."""
    vs, us, ws, ns = [], [], [], []
    for steps, u, first, w, n in lists:
        sizes = np.diff(np.append(np.cumsum(first, dtype=np.int64), len(w)))
        vs.append(np.repeat(np.cumsum(steps, dtype=np.int64), sizes))
        us.append(np.repeat(u.astype(np.int64), sizes))
        ws.append(w.astype(np.int64))
        ns.append(n)
    at = np.cumsum([0, *[len(w) for w in ws]])
    named, (v, u, w) = [], (np.concatenate(x) for x in (vs, us, ws))
    del vs, us, ws
    dense = []
    for x in (v, u, w):
        values, x = np.unique(x, return_inverse=True)
        named.append(values)
        dense.append(x)
    (v, u, w), where = _distinct(*dense)
    del dense
    n = _sums(where, np.concatenate(ns), len(w))
    asks = [where[a:b] for a, b in zip(at, at[1:])]
    first = _runs(v, u)
    (pv, pw), pair = _distinct(v, w)
    v_id, w_id = named[0][pv], named[2][pw]
    hot = np.minimum(np.searchsorted(model["hot"], v_id), max(len(model["hot"]) - 1, 0))
    hot = np.where(model["hot"][hot] == v_id, hot + 1, 0) if len(model["hot"]) else np.zeros(len(v_id), np.int64)
    keys, outer = _distinct(w_id % model["parts"], hot, w_id // model["parts"])
    block = {"n": _smallest(n), "first": _steps(first), "pair": _smallest(pair), "v": _steps(pv), "hot": hot > 0, "outer": _smallest(outer), "keys": len(keys[0])}
    return block, asks, np.array(keys)


class Restaurants:
    """The restaurants of a block, ready to compute with."""

    def __init__(self, block: dict, model: dict):
        self.m, self.hot, self.keys = model, block["hot"], block["keys"]
        self.n, self.pair, self.outer = (block[k].astype(np.int64) for k in ("n", "pair", "outer"))
        self.v = np.cumsum(block["v"], dtype=np.int64)
        first = np.cumsum(block["first"], dtype=np.int64)
        self.context = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(self.n))))

    def first_seating(self) -> dict:
        t3 = (self.n > 0).astype(np.int64)
        return {"t3": t3, "t2": (_sums(self.pair, t3, len(self.v)) > 0).astype(np.int64)}

    def sent(self, seats: dict) -> np.ndarray:
        """Customers passed on, by key: tables of a word, or customers of a word after a frequent token."""
        return _sums(self.outer, np.where(self.hot, _sums(self.pair, seats["t3"], len(self.v)), seats["t2"]), self.keys)

    def parents(self, seats: dict, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each pair, and how much of it a new table has, before its word's probability."""
        m, c = self.m, _sums(self.pair, seats["t3"], len(self.v))
        size = int(self.v[-1]) + 1 if len(self.v) else 0
        fresh = (m["strength"][1] + m["discount"][1] * _sums(self.v, seats["t2"], size))[self.v]
        p = (c - m["discount"][1] * seats["t2"] + fresh * outer[self.outer]) / (m["strength"][1] + _sums(self.v, c, size))[self.v]
        return np.where(self.hot, outer[self.outer], p), fresh

    def predictive(self, seats: dict, outer: np.ndarray) -> np.ndarray:
        m, n = self.m, int(self.context[-1]) + 1
        p, _ = self.parents(seats, outer)
        fresh = m["strength"][2] + m["discount"][2] * _sums(self.context, seats["t3"], n)
        return (self.n - m["discount"][2] * seats["t3"] + fresh[self.context] * p[self.pair]) / (m["strength"][2] + _sums(self.context, self.n, n))[self.context]

    def resample(self, seats: dict, outer: np.ndarray, rng: np.random.Generator) -> dict:
        m, n = self.m, int(self.context[-1]) + 1
        p, fresh2 = self.parents(seats, outer)
        fresh3 = m["strength"][2] + m["discount"][2] * _sums(self.context, seats["t3"], n)
        t3 = seat(rng, self.n, fresh3[self.context] * p[self.pair], m["discount"][2])
        c = np.where(self.hot, 0, _sums(self.pair, t3, len(self.v)))
        return {"t3": t3, "t2": seat(rng, c, fresh2 * outer[self.outer], m["discount"][1])}


# ---- parts: the restaurant without context, and dishes of frequent tokens


def part_of(lists: list[np.ndarray]) -> dict:
    """lists: for each block the keys (hot, rank) of its dishes. dishes: words by rank, then the words after frequent tokens."""
    hot, rank = (np.concatenate([x[i] for x in lists]) for i in (0, 1))
    words = int(rank.max()) + 1
    (after, word), where = _distinct(hot[hot > 0], rank[hot > 0])
    index = rank.copy()
    index[hot > 0] = words + where
    at = np.cumsum([0, *[x.shape[1] for x in lists]])
    return {"words": words, "after": _smallest(after - 1 if len(after) else after), "word": _smallest(word), "index": [_smallest(index[a:b]) for a, b in zip(at, at[1:])]}


class Dishes:
    def __init__(self, part: dict, model: dict):
        self.m, self.words, self.index = model, part["words"], part["index"]
        self.after, self.word = part["after"].astype(np.int64), part["word"].astype(np.int64)

    def customers(self, counts: list[np.ndarray]) -> np.ndarray:
        return _sums(np.concatenate(self.index).astype(np.int64), np.concatenate(counts), self.words + len(self.word))

    def seating(self, counts: list[np.ndarray], before: dict | None, totals: dict | None, rng) -> dict:
        """Tables of the words after frequent tokens, and of words; the first seating has one a dish."""
        c, m = self.customers(counts), self.m
        if before is None:
            t1 = (c[self.words :] > 0).astype(np.int64)
        else:
            t1 = seat(rng, c[self.words :], (m["strength"][1] + m["discount"][1] * totals["t"][1:])[self.after] * self.word_p(before, totals)[self.word], m["discount"][1])
        c0 = c[: self.words] + _sums(self.word, t1, self.words)
        t0 = (c0 > 0).astype(np.int64) if before is None else seat(rng, c0, np.full(self.words, self.fresh(totals)), m["discount"][0])
        return {"c0": c0, "t0": t0, "c1": c[self.words :], "t1": t1}

    def fresh(self, totals: dict) -> float:
        return (self.m["strength"][0] + self.m["discount"][0] * totals["t"][0]) / (self.m["known"] + 1)

    def word_p(self, s: dict, totals: dict) -> np.ndarray:
        return (s["c0"] - self.m["discount"][0] * s["t0"] + self.fresh(totals)) / (self.m["strength"][0] + totals["c"][0])

    def probabilities(self, s: dict, totals: dict) -> np.ndarray:
        m, p = self.m, self.word_p(s, totals)
        fresh = (m["strength"][1] + m["discount"][1] * totals["t"][1:])[self.after]
        return np.concatenate([p, (s["c1"] - m["discount"][1] * s["t1"] + fresh * p[self.word]) / (m["strength"][1] + totals["c"][1:])[self.after]])

    def totals(self, s: dict) -> list[dict]:
        out = [{"k": 0, "t": int(s["t0"].sum()), "c": int(s["c0"].sum())}]
        t, c = (_sums(self.after, s[k], len(self.m["hot"])) for k in ("t1", "c1"))
        return out + [{"k": int(k) + 1, "t": int(t[k]), "c": int(c[k])} for k in np.flatnonzero(c)]


# ---- the exchanges


_TYPES = {"kind": "string", "block": "long", "part": "long", "chunk": "long", "key": "long", "data": "binary", "static": "binary", "asks": "binary", "totals": "array<struct<k: long, t: long, c: long>>"}
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), _TYPES["totals"]: pa.list_(pa.struct([("k", pa.int64()), ("t", pa.int64()), ("c", pa.int64())]))}
MOVED, BUILT, SEATED = "kind block part data".split(), "kind block part data static asks".split(), "kind block part data totals".split()


def _schema(names: list[str]) -> str:
    return ", ".join(f"{x} {_TYPES[x]}" for x in names)


def _rows(names: list[str], rows: list[dict]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r.get(x) for r in rows], _ARROW[_TYPES[x]]) for x in names], names)


def _of(table: pa.Table, kind: str, key: str) -> list[tuple[int, object]]:
    """(key, data) of the rows of a kind, by key."""
    found = [(k, d) for x, k, d in zip(table.column("kind").to_pylist(), table.column(key).to_pylist(), table.column("data").to_pylist(), strict=True) if x == kind]
    return [(k, _unsqueeze(d)) for k, d in sorted(found, key=lambda x: x[0])]


def _seed(model: dict, *more: int):
    return np.random.default_rng([model["seed"], *more])


def _outer_rows(block: int, parts: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> list[tuple]:
    """Rows of the counts of a block's keys, for each part that holds some."""
    names, first = np.unique(parts, return_index=True)
    ends = zip(names, first, [*first[1:], len(parts)], strict=True)
    return [{"kind": "outer", "block": block, "part": int(p), "data": _squeeze((_smallest(counts[a:b]), *[_smallest(x[a:b]) for x in more]))} for p, a, b in ends]


def _seats_row(kind: str, name: str, at: int, seats: dict, **more) -> dict:
    return {"kind": kind, name: at, "data": _squeeze({k: _smallest(x) for k, x in seats.items()}), **more}


def _seats(table: pa.Table, kind: str, key: str) -> dict:
    ((_, found),) = _of(table, kind, key)
    return {k: x.astype(np.int64) for k, x in found.items()}


def build_blocks(sent: DataFrame, model: dict) -> DataFrame:
    """A row of each block with its restaurants (static) and what chunks asked for (asks), its first seating, and rows of kind outer: the
    first customers of each part, with their keys."""

    def run(group: pa.Table) -> pa.Table:
        b = group.column("block")[0].as_py()
        found = sorted(zip(group.column("chunk").to_pylist(), group.column("data").to_pylist(), strict=True))
        block, asks, keys = block_of([_unsqueeze(x) for _, x in found], model)
        r = Restaurants(block, model)
        seats = r.first_seating()
        block["parts"] = _smallest(keys[0])
        packed = _squeeze([(key, _steps(x)) for (key, _), x in zip(found, asks, strict=True)])
        rows = [{"kind": "static", "block": b, "static": _squeeze(block), "asks": packed}, _seats_row("seats", "block", b, seats)]
        return _rows(BUILT, rows + _outer_rows(b, keys[0], r.sent(seats), *keys[1:]))

    return sent.repartition(model["blocks"], "block").groupBy("block").applyInArrow(run, _schema(BUILT))  # a task holds a few blocks at any size


def build_parts(outer: DataFrame, model: dict) -> DataFrame:
    """Two rows of each part: its dishes (kind part) and their first seating (kind dishes)."""

    def run(group: pa.Table) -> pa.Table:
        p, found = group.column("part")[0].as_py(), _of(group, "outer", "block")
        part = part_of([np.array(x[1:], np.int64) for _, x in found])
        part["blocks"] = [b for b, _ in found]
        dishes = Dishes(part, model)
        s = dishes.seating([x[0] for _, x in found], None, None, None)
        return _rows(SEATED, [{"kind": "part", "part": p, "data": _squeeze(part)}, _seats_row("dishes", "part", p, s, totals=dishes.totals(s))])

    return outer.groupBy("part").applyInArrow(run, _schema(SEATED))


def reseat_parts(static: DataFrame, outer: DataFrame, dishes: DataFrame, model: dict, totals: dict, turn: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ((p, part),) = _of(left, "part", "part")
        d = Dishes(part, model)
        s = d.seating([x[0] for _, x in _of(right, "outer", "block")], _seats(right, "dishes", "part"), totals, _seed(model, 0, turn, p))
        return _rows(SEATED, [_seats_row("dishes", "part", p, s, totals=d.totals(s))])

    return static.groupBy("part").cogroup(outer.unionByName(dishes).groupBy("part")).applyInArrow(run, _schema(SEATED))


def replies(static: DataFrame, dishes: DataFrame, model: dict, totals: dict, turn: int) -> DataFrame:
    """Rows of kind p<turn>: the probabilities of each block's keys."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ((p, part),) = _of(left, "part", "part")
        d = Dishes(part, model)
        found = d.probabilities(_seats(right, "dishes", "part"), totals).astype(np.float32)
        return _rows(MOVED, [{"kind": f"p{turn}", "block": b, "part": p, "data": _squeeze(found[at])} for b, at in zip(part["blocks"], d.index, strict=True)])

    return static.groupBy("part").cogroup(dishes.groupBy("part")).applyInArrow(run, _schema(MOVED))


def _outer(right: pa.Table, turn: int) -> np.ndarray:
    return np.concatenate([x for _, x in _of(right, f"p{turn}", "part")]).astype(np.float64)


def reseat_blocks(static: DataFrame, seats: DataFrame, probabilities: DataFrame, model: dict, turn: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b, block = left.column("block")[0].as_py(), _unsqueeze(left.column("static")[0].as_py())
        r = Restaurants(block, model)
        new = r.resample(_seats(right, "seats", "block"), _outer(right, turn), _seed(model, 1, turn, b))
        return _rows(MOVED, [_seats_row("seats", "block", b, new), *_outer_rows(b, block["parts"], r.sent(new))])

    return static.select("block", "static").groupBy("block").cogroup(seats.unionByName(probabilities).groupBy("block")).applyInArrow(run, _schema(MOVED))


def answers(static: DataFrame, samples: DataFrame, model: dict, turns: list[int]) -> DataFrame:
    """(chunk, key, kind, data): for each block and chunk, the log10 of the mean probability of each triple that the chunk sent, in
    whole steps of -1 / STEP."""
    names = "chunk key kind data".split()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b, block = left.column("block")[0].as_py(), _unsqueeze(left.column("static")[0].as_py())
        r, p = Restaurants(block, model), 0.0
        for turn in turns:
            p = p + r.predictive(_seats(right, f"seats{turn}", "block"), _outer(right, turn))
        logs = _smallest(np.rint(-STEP * np.log10(p / len(turns))).astype(np.int64))
        asks = _unsqueeze(left.column("asks")[0].as_py())
        return _rows(names, [{"chunk": key, "key": b, "kind": "logs", "data": _squeeze(logs[np.cumsum(at, dtype=np.int64)])} for key, at in asks])

    return static.select("block", "static", "asks").groupBy("block").cogroup(samples.groupBy("block")).applyInArrow(run, _schema(names))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(table: DataFrame, found: DataFrame, model: dict) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for data in left.column("data").to_pylist():
            chunk = _unsqueeze(data)
            kind = pc.equal(right.column("kind"), "words")
            ids, c = _named(chunk, right.filter(kind), model["parts"])
            logs = right.filter(pc.invert(kind))
            logs = [_unsqueeze(x) for _, x in sorted(zip(logs.column("key").to_pylist(), logs.column("data").to_pylist(), strict=True))]
            log = np.concatenate(logs)[triples(chunk, ids, model)["where"]] / -STEP
            base = np.log10((c + 0.1) / (model["n_train"] + 0.1 * (model["known"] + 1)))[chunk["tokens"]]
            at, n = np.cumsum(chunk["lengths"]) - chunk["lengths"], len(chunk["lengths"])
            known = np.add.reduceat((c > 0)[chunk["tokens"]].astype(np.int64), at)
            out.append(pa.table([pa.array(chunk["doc_ids"], pa.int64()), pa.array(chunk["held"]), pa.array(chunk["lengths"].astype(np.int64)), pa.array(known), pa.array(np.full(n, model["n_train"])), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(log, at))], [x.split()[0] for x in SCORES.split(", ")]))
        return pa.concat_tables(out)

    return table.select("chunk", "data").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, SCORES)


def train_and_score(docs: DataFrame, held_out, rounds: int = 4, burn_in: int = 1, seed: int = 11, order: int = 3, discount: tuple = (0.7, 0.75, 0.75), strength: tuple = (10.0, 1.0, 0.5), block_tokens: int = 1_500_000) -> DataFrame:
    """Train on the rows that held_out does not mark, and score all rows. Perplexity of rows: 10 ** (-sum(score) / sum(n_tokens)).

    discount and strength: of the restaurant without context, of those of one token and of two; order 2 leaves out the last.
    rounds after the first burn_in are averaged. block_tokens: tokens a block and a part of the work; it should fit a task's memory."""
    spark = docs.sparkSession
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = bucketed(chunks(docs, held_out), min(max(few, docs.rdd.getNumPartitions()), MOST_BUCKETS), "chunk")  # a task writes few chunks, so few files
    sums = table.agg(F.sum("n_train").alias("n"), F.sum("n_tokens").alias("all")).first()
    blocks = max(1, -(-(sums["all"] or 0) // block_tokens), few)
    model = {"n_train": sums["n"] or 0, "blocks": blocks, "parts": blocks, "seed": seed, "order": order, "discount": discount, "strength": strength}
    words = stored(vocabulary(table, model["parts"], block_tokens // 8))
    model["known"] = int(words.agg(F.sum("known")).first()[0] or 0)
    model["hot"] = np.sort(np.array([r["id"] for r in words.select(F.explode("often").alias("w")).select("w.id").collect()], np.int64))  # at most 8 a block
    words = words.where("chunk IS NOT NULL").select("chunk", F.col("part").alias("key"), F.lit("words").alias("kind"), "data")
    release(spark)

    built = bucketed(build_blocks(requests(table, words, model), model), min(blocks, MOST_BUCKETS), "block")
    static, seats, outer = (built.where(F.col("kind") == k) for k in ("static", "seats", "outer"))
    seats, outer = seats.select(*MOVED), outer.select(*MOVED)
    parts = stored(build_parts(outer, model), "kind")
    release(spark)
    shelf, dishes = parts.where("kind = 'part'").select(*MOVED), parts.where("kind = 'dishes'")

    def totals_of(dishes: DataFrame) -> dict:
        found = {k: np.zeros(len(model["hot"]) + 1) for k in "tc"}
        for r in dishes.select(F.explode("totals").alias("x")).groupBy("x.k").agg(F.sum("x.t").alias("t"), F.sum("x.c").alias("c")).collect():  # a row a frequent token
            found["t"][r["k"]], found["c"][r["k"]] = r["t"], r["c"]
        return found

    samples, turns, spent = None, [], []
    for turn in range(rounds + 1):
        totals = totals_of(dishes)
        p = stored(replies(shelf, dishes.select(*MOVED), model, totals, turn))
        if turn > burn_in or turn == rounds:
            both = p.unionByName(seats.withColumn("kind", F.lit(f"seats{turn}")))
            samples, turns = both if samples is None else samples.unionByName(both), [*turns, turn]
        else:
            spent.append(p)
        if turn < rounds:
            moved = stored(reseat_blocks(static, seats, p, model, turn), "kind")
            seats, outer = (moved.where(F.col("kind") == k).select(*MOVED) for k in ("seats", "outer"))
            before, dishes = dishes, stored(reseat_parts(shelf, outer, dishes.select(*MOVED), model, totals, turn))
            discard(*spent, *([before] if turn else []))
            spent = [moved] if turn + 1 <= burn_in and turn + 1 < rounds else []
            release(spark)
    found = answers(static, samples, model, turns)
    return scores(table, words.unionByName(found.select(*words.columns)), model)


def op2_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(documents(spark, sf_dir).select("doc_id", "text"), ~training_row(10))
