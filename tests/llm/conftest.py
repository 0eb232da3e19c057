import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("size", pa.int32()), ("fp", pa.string()), ("length", pa.string()), ("score", pa.string())])


def edge_rows():
    """Nulls, empty and long texts, ties, repeated rows, white space of all kinds; other columns clash with the operators' names."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(120)
    line = "This Line stands in many documents."
    texts = ["", None, " \t\n", "\n\n", "one", "two words", "a\x0bb\x0cc\rd", "Ünïcode wörds ÄÖ and no-break  spaces x", "tail\n", line, f"  {line.upper()}  \n{line}\nown words here {prose(5)}"]
    texts += [base, base, base, base.upper(), base + " more", base.replace(" ", "\n", 30), prose(60000), "word " * 500, "# * $ % " * 40]
    texts += [f"{prose(40)}\n{line}\n{prose(30)}\n{prose(3)}" for _ in range(30)]
    texts += ["<|endoftext|> inside", "don't  double  spaces   triple\n\n\nlines", "x" * 70_000]
    rows = [(i * 5 % 97 if i else 0, t, "en", f"s{i % 4}" if i % 11 else None, i) for i, t in enumerate(texts)]
    rows += [rows[11], rows[11], rows[21], (None, base, None, None, None), (None, None, None, None, None), (None, f"{line}\n{prose(20)}", "en", "s1", 3)]
    return rows


def write(path, rows):
    path.mkdir()
    cols = list(zip(*rows)) if rows else [[]] * 5
    n = len(rows)
    table = pa.table([*[pa.array(c, t) for c, t in zip(cols, SCHEMA.types)], pa.array([1] * n, pa.int32()), *[pa.array(["x"] * n, pa.string())] * 3], schema=SCHEMA)
    pq.write_table(table, path / "documents.parquet")
    labelled = sorted({r[0] for r in rows if r[0] is not None})
    pq.write_table(pa.table({"doc_id": pa.array([*labelled, None], pa.int64()), "quality": pa.array([*[i % 2 for i in range(len(labelled))], 1], pa.int32()), "toxic": pa.array([0] * (len(labelled) + 1), pa.int32())}), path / "labels.parquet")
    return str(path)


@pytest.fixture(scope="session")
def edge(tmp_path_factory):
    rows = edge_rows()
    return write(tmp_path_factory.mktemp("edge") / "d", rows), rows


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty") / "d", [])


def rows_of(spark, sf_dir):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.fixture(scope="session", params=["edge", "sf0.001"])
def case(request, spark, edge):
    """(folder, rows): the edge cases, and the smallest of the given tables."""
    if request.param == "edge":
        return edge
    d = "/root/testdata/sf0.001"
    return d, rows_of(spark, d)
