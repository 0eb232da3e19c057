"""Each stage on the edge cases: it keeps the columns of documents and does what its operator says."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline as p
from sparvox.llm.packing import vocabulary_path
from sparvox.llm.quality import fit
from sparvox.llm.simhash import fingerprint

from test_ops import targets


def test_stages(spark, edge):
    docs = spark.read.parquet(f"{edge[0]}/documents.parquet")
    for i, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, edge[0])
        if i < len(p.STAGES) - 1:
            assert out.columns == p.COLUMNS
            assert Counter(r["doc_id"] for r in out.collect()).keys() <= Counter(r["doc_id"] for r in docs.collect()).keys()
            docs = p.stored(out)


def brute_near(rows):
    """The (doc_id, text) that stay: of each component of close fingerprints or similar texts, the smallest doc_id's (null last), by text key."""
    texts = sorted({t or "" for _, t in rows})
    words = [t.encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    fps = [fingerprint(t.encode()) for t in texts]
    root = list(range(len(texts)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i in range(len(texts)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & ((1 << 64) - 1)).bit_count() <= 3 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(set)
    for d, t in rows:
        groups[find(texts.index(t or ""))].add((d is None, d or 0, t or ""))
    return groups


def as_docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_keeps_one_of_each_group(spark, edge):
    """Equal and null doc_ids and repeated rows: one row of each group stays, and no group is lost."""
    rows = [(r[0], r[1]) for r in edge[1]]
    rows += [(1, "aa bb cc dd ee ff"), (5, "aa bb cc dd ee ff"), (5, "other text under the same number"), (None, "xx yy zz"), (None, "xx yy zz"), (9, "qq rr ss tt"), (9, "qq rr ss tt"), (None, "a text of its own without number")]
    groups = brute_near(rows)
    kept = [(r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in p.near(spark, as_docs(spark, rows), "").collect()]
    assert len(kept) == len(groups)
    for members in groups.values():
        (stays,) = [k for k in kept if k in members]
        assert stays[:2] == min(members)[:2]


def test_lines_by_brute_force(spark, edge):
    last = 1 << 63
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for d, t in {(r[0], r[1]) for r in edge[1]}:
        for x in (t or "").split("\n"):
            first[key(x)] = min(first.get(key(x), last), last if d is None else d)
    want = Counter()
    for d, t, *_ in edge[1]:
        kept = [x for x in (t or "").split("\n") if len(key(x)) < 10 or first[key(x)] == (last if d is None else d)]
        want[d, "\n".join(kept)] += 1
    docs = spark.read.parquet(f"{edge[0]}/documents.parquet")
    got = p.lines(spark, docs, edge[0]).collect()
    assert Counter((r["doc_id"], r["text"] or "") for r in got) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)


def test_quality_by_brute_force(spark):
    """The rows that stay are those whose compressed sizes, worked out one by one, score 0.3 or more."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    good, bad = (zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(x), write_checksum=False, write_content_size=False, write_dict_id=False) for x in (model.good, model.bad))
    plain = zstandard.ZstdCompressor(level=model.level, write_checksum=False, write_content_size=False)
    want = Counter()
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        a, b, c = (len(x.compress(raw)) for x in (good, bad, plain))
        diff = (b - a) / (a + b) if raw else 0.0
        z = np.dot(model.weights, [1, 10 * diff, diff * np.log1p(len(raw)), 10 * max(0, 0.35 - c / len(raw)) if raw else 0])
        if 1 / (1 + np.exp(-z)) >= 0.3:
            want[r["doc_id"], r["text"]] += 1
    assert 0 < want.total() < docs.count()
    assert Counter((r["doc_id"], r["text"]) for r in p.quality(spark, docs, d).collect()) == want


def test_mixing_by_brute_force(spark, edge):
    docs = spark.read.parquet(f"{edge[0]}/documents.parquet").select(*p.COLUMNS)
    rows = [tuple(r) for r in docs.collect()]
    size = lambda t: len((t or "").encode().split())
    totals = Counter()
    for _, t, _, s, _ in rows:
        totals[s] += size(t)
    rate = {s: x / totals[s] if totals[s] else 0 for s, x in targets(totals).items()}
    want = Counter()
    for r in rows:
        text = hashlib.sha256((r[1] or "").encode()).hexdigest()
        unit = int(hashlib.sha256(f"17:{'' if r[0] is None else r[0]}:{r[3] or ''}:{text}".encode()).hexdigest()[:13], 16) / (1 << 52)
        want[r] += int(rate[r[3]]) + (unit < rate[r[3]] - int(rate[r[3]]))
    assert Counter(tuple(r) for r in p.mixing(spark, docs, edge[0]).collect()) == +want


def test_packing_by_brute_force(spark, edge):
    plain = Tokenizer.from_file(vocabulary_path())
    docs = spark.read.parquet(f"{edge[0]}/documents.parquet")
    want = Counter()
    for d, t, *_ in edge[1]:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for i, (a, b) in enumerate(zip([0, *range(first, len(ids), 1024)], range(first, len(ids) + 1, 1024))):
            want[d, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = p.packing(spark, docs, edge[0]).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    used = Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024 and len(used) <= 1.02 * sum(used.values()) / 1024 + 1


def test_near_finds_all_similar_texts(spark):
    """Texts with 0.8 of their shingles in common are found at any distance of fingerprints; in chains and in groups as well."""
    import numpy as np
    from sparvox.llm.simhash import fingerprint

    rng = np.random.default_rng(6)
    vocab, common, texts = [f"w{i}" for i in range(500)], [f"c{i}" for i in range(30)], []
    for _ in range(25):
        base = [*rng.choice(vocab, int(rng.integers(20, 90))), *common]
        for _ in range(8):
            texts.append(" ".join(base))
            base = list(base) if rng.random() < 0.5 else [*base, *rng.choice(vocab, int(rng.integers(1, 9)))]
            for i in rng.choice(len(base), int(rng.integers(0, 4)), replace=False):
                base[i] = f"n{rng.integers(10**6)}"
    texts += ["", None, "one", "ONE", "two words", "a b c d", "a b c d e", "a b c d e f"]
    words = [(t or "").lower().encode().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    fps = [fingerprint((t or "").encode()) for t in texts]
    root, far = list(range(len(texts))), 0

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i in range(len(texts)):
        for j in range(i):
            bits = ((fps[i] ^ fps[j]) & ((1 << 64) - 1)).bit_count()
            similar = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            far += similar and bits > 5
            if bits <= 3 or similar:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert far > 20
    assert {r["doc_id"] for r in p.near(spark, docs, "").collect()} == {i for i in range(len(texts)) if find(i) == i}


def test_near_moves_only_texts_that_may_be_similar(spark, monkeypatch):
    """Texts with some shingles in common by chance are told apart by their sketches, so that no sets of shingles are made of them; of the
    stage's tables only the fingerprints and their classes stay."""
    from sparvox.llm import simhash

    rng = np.random.default_rng(8)
    common = [f"c{i}" for i in range(6)]
    texts = [" ".join(np.concatenate([rng.choice([f"w{i}" for i in range(300)], 60), *[rng.choice(common, 12) for _ in range(5)]])) for _ in range(200)]
    texts.append(texts[7] + " end")
    made, tables = [], []

    def sets(rows, words, real=simhash.shingle_sets):
        made.append(rows.count())
        return real(rows, words)

    def stored(df, real=simhash.stored):
        tables.append(real(df))
        return tables[-1]

    monkeypatch.setattr(simhash, "shingle_sets", sets)
    monkeypatch.setattr(simhash, "stored", stored)
    docs = as_docs(spark, list(enumerate(texts)))
    groups = brute_near(list(enumerate(texts)))
    assert {r["doc_id"] for r in p.near(spark, docs, "").collect()} == {min(g)[1] for g in groups.values()}
    assert len(groups) == 200 and sum(made) <= 4
    hadoop = spark._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(t.stored_at) for t in tables]
    left = [t.columns for t, path in zip(tables, paths) if path.getFileSystem(hadoop).exists(path)]
    assert ["doc_id", "text_key", "fp"] in left and ["fp", "root"] in left
    assert not [c for c in left if set(c) & {"tokens", "token", "sketch", "grams"}] and ["a", "b"] not in left


def test_sketches_never_part_similar_sets():
    """The sketches' distance is no more than the number of hashes in one set alone, whatever the sizes."""
    from sparvox.llm.simhash import apart, sketch

    rng = np.random.default_rng(9)
    as_bytes = lambda x: np.frombuffer(sketch(np.unique(x)), np.uint8)
    for n in (1, 2, 63, 64, 65, 130, 1000, 5000):
        x = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n))
        assert n / 8 <= len(as_bytes(x)) <= max(8, n / 4)
        for drop, more in ((0, 0), (0, n // 9), (n // 9, 0), (n // 3, n // 3), (0, 3 * n), (n - 1, 1), (n - 1, n)):
            y = np.unique(np.concatenate([x[drop:], rng.integers(-(1 << 63), (1 << 63) - 1, more)]))
            assert apart(as_bytes(x), as_bytes(y)) <= len(np.setxor1d(x, y))
    x, y = (np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, 400)) for _ in range(2))
    assert apart(as_bytes(x), as_bytes(y)) > 800 / 9 + 20
