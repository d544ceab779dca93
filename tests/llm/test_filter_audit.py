"""The audit of filters against its SQL and against brute force over every order."""

from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import filter_audit as audit

DOCS = "doc_id long, text string, source string, mask int, h1 int, part string, quality int, n int"
LONG = " ".join(f"word{k}" for k in range(60))
TEXTS = [None, "", " \t\n", "few words", LONG, LONG, "same " * 60, LONG.upper(), LONG + " 50%", "A b # c", "$ " * 70, "É" * 80, LONG + "\x0bx\x0cy", "x" * 30_000, "X" * 30_000 + " y" * 70, "few words"]


def rows():
    got = [(k, t, f"s{k % 3}" if k % 5 else None, 9, 9, "p", 1, 1) for k, t in enumerate(TEXTS)]
    return got + [(None, LONG, "s1", 9, 9, "p", 1, 1), (None, LONG, "s1", 9, 9, "p", 1, 1), (4, LONG, "s1", 9, 9, "p", 1, 1), (5, LONG, "s1", 9, 9, "p", 1, 1), (5, "other text", "s1", 9, 9, "p", 1, 1), (90, "", "", 9, 9, "p", 1, 1)]


LABELS = [(0, 1, 0), (3, 1, None), (3, 0, 1), (5, 1, 1), (6, None, 1), (8, 1, 0), (9, 1, 1), (None, 1, 1), (77, 1, 1), (15, 1, 1)]


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    flagged = []
    for i, t, source, *_ in docs:
        t = t or ""
        words = t.encode().split()
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        flagged.append((source or "", {f for f, bad in fails.items() if bad}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in flagged}:
        own = [f for f in flagged if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                redundant = sum(f in x[1] for x in own) - len(here)
                out[part, order, step] = [len(left), len(here), redundant, sum(x[1] == {f} for x in own), sum(x[2] for x in here), sum(x[3] for x in here)]
    for (part, order, step), counts in out.items():
        counts.append(sum(c[1] for (p, o, s), c in out.items() if p == part and o[s - 1] == order[step - 1]))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("audit"))
    spark.createDataFrame(rows(), DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("cells", [1 << 29, 64])
def test_every_order(spark, tables, monkeypatch, cells):
    """A sketch too small for its texts clears nothing and changes nothing."""
    if cells == 64:
        monkeypatch.setattr(audit, "PART_CELLS", 16)
        monkeypatch.setattr(audit, "MOST_CELLS", 64)
        monkeypatch.setattr(audit, "HELD_CELLS", 5)
    found = audit.op13_filter_audit(spark, tables).collect()
    got = {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in found}
    assert len(got) == len(found) and got == brute(rows(), LABELS)


def test_sql(tables):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet/*.parquet'")
    assert {tuple(r[:3]): list(r[3:]) for r in con.sql(audit.OP13_SQL).fetchall()} == brute(rows(), LABELS)


def test_sketch_clears_no_repeat_and_most_others(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "cast(id % 2000 AS string) AS text", "'s' AS source").repartition(5)
    marked = audit.marks(docs).cache()
    n_cells = audit._n_cells(3000)
    full = np.zeros(n_cells, bool)
    for part, bits in audit.sketch(marked, n_cells).collect():
        full[part * audit.PART_CELLS : (part + 1) * audit.PART_CELLS] = np.unpackbits(np.frombuffer(bits, np.uint8))
    repeats = 0
    for h1, h2, doc_id in marked.select("h1", "h2", "doc_id").collect():
        hit = all(full[c[0]] for c in audit._cells(pa.array([h1]), pa.array([h2]), n_cells))
        assert hit or 1000 <= doc_id < 2000
        repeats += hit
    assert repeats < 2000 + 100
    assert sorted(r["doc_id"] for r in audit.copies(docs, marked).collect()) == list(range(2000, 3000))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert audit.op13_filter_audit(spark, str(tmp_path)).count() == 0
