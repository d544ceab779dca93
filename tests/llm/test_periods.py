"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quillgraph.llm import periods

SCHEMA = "doc_id long, text string, runs string, raw int, collapsed int"


def brute(words):
    """Runs by trying every period, smallest first."""
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        start = 0
        for k in range(q, n + 1):
            if k == n or words[k] != words[k - q]:
                if k - start >= max(24, 3 * q):
                    found.setdefault((start, k), q)
                start = k - q + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def check(docs):
    words = np.array([w for d in docs for w in d], np.int32)
    got = periods.find_runs(words, np.append(0, np.cumsum([*map(len, docs)])))
    for doc, runs in zip(docs, got, strict=True):
        assert runs == brute(doc), doc
    return sum(map(len, got))


def some(r):
    kinds, n, out = r.choice([1, 2, 3, 5, 50]), r.randint(0, 300), []
    while len(out) < n:
        if r.random() < 0.5:
            out += [r.randrange(kinds) for _ in range(r.randint(1, 30))]
        else:
            period = [r.randrange(kinds) for _ in range(r.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 60]))]
            out += (period * r.randint(2, 9))[: r.randint(1, 200)]
    return out


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b


def test_runs():
    r = random.Random(3)
    assert sum(check([some(r) for _ in range(50)]) for _ in range(12)) > 500
    assert check([fibonacci(1000), [0] * 2000, [0, 1] * 500 + [2] * 700, list(range(300)) * 3 + [1], list(range(300)) * 4, list(range(8)) * 3, list(range(8)) * 2 + list(range(7))]) > 60


@pytest.mark.parametrize("longest", [8, 32])
def test_blocks_cut_to_the_longest(monkeypatch, longest):
    monkeypatch.setattr(periods, "LONGEST_BLOCK", longest)
    r = random.Random(4)
    check([some(r) for _ in range(60)] + [fibonacci(600), list(range(400)) * 3, list(range(500)) * 4 + [7]])


def test_wrong_candidates_are_no_runs(monkeypatch):
    """Residues that say little give blocks that only seem to occur again: words decide."""
    monkeypatch.setattr(periods, "_residues", lambda numbers: (numbers % 2).astype(np.float64))
    r = random.Random(5)
    check([some(r) for _ in range(60)])


@pytest.mark.parametrize("n", [1, 2, 16, 64, 128, 256, 2048, 8192, 1 << 18])
def test_transform_is_exact(n):
    r = np.random.default_rng(n)
    x = periods._mod(r.integers(0, periods.PRIME, (2, n)).astype(np.float64))
    there = periods._mod(periods.transform(x.copy()))
    back = periods.transform(there.copy(), -1, pow(n, periods.PRIME - 2, periods.PRIME))
    assert not ((back - x) % periods.PRIME).any()
    if n <= 256:
        root = pow(periods.GENERATOR, (periods.PRIME - 1) // n, periods.PRIME)
        want = [sum(int(v) * pow(root, j * k, periods.PRIME) for j, v in enumerate(x[0])) % periods.PRIME for k in range(n)]
        assert (there[0] % periods.PRIME).tolist() == want


@pytest.mark.parametrize("scale", [8, 16, 64])
def test_occurrences_are_all_found(scale):
    r = np.random.default_rng(scale)
    values = r.integers(0, 2, 700).astype(np.float64)
    values[300:500] = np.resize(values[300 : 300 + scale + 3], 200)
    place, distance = periods.occurrences(values, scale)
    low = 1 if scale == 8 else scale
    want = {(p, d) for p in range(0, 700, scale) for d in range(low, 2 * scale) if p + d + scale <= 700 and (values[p : p + scale] == values[p + d : p + d + scale]).all()}
    assert set(zip(place.tolist(), distance.tolist(), strict=True)) == want and want


def text_of(words):
    return "".join(f"w{w}" + [" ", "\n", "\t \r"][k % 3] for k, w in enumerate(words))


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(periods, "GROUP_WORDS", 500)
    r = random.Random(6)
    texts = [None, "", " \n", "a " * 24, "a " * 23, "\x0bb\x0cé " * 40, "x y " * 30, "long word " * 4000] + [text_of(some(r)) for _ in range(150)]
    rows = [(k, t, "x", 1, 2) for k, t in enumerate(texts)] + [(None, "z " * 30, "x", 1, 2), (9, texts[9], "x", 1, 2), (9, texts[9], "x", 1, 2)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periods.op11_block_periods(spark, str(tmp_path)).collect()), key=str)
    want = sorted((expected(*row[:2]) for row in rows), key=str)
    assert got == want
    assert sum(1 for w in want if zlib.crc32(str(w[0]).encode()) % 10 == 0) > 5


def test_operator(spark):
    docs = spark.createDataFrame([(1, "pre " + "a b " * 15 + "post", "x", 1, 2)], SCHEMA)
    row = periods.periodic_runs(docs).first()
    assert row["n_words"] == 32 and [tuple(x) for x in row["runs"]] == [(1, 30, 2)] and bytes(row["collapsed"]) == b"pre a b post"
    assert periods.periodic_runs(docs.limit(0)).count() == 0
