"""Byte-level BPE against the tiktoken library, and the round trip."""

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken

from quillgraph.llm import bpe

SCHEMA = "doc_id long, text string, ids string, raw int, decoded int"


@pytest.fixture(scope="module")
def library():
    with open(bpe.ranks_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.split_pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Ranks.of(bpe.ranks_path()), bpe.split_pattern())


def encoded(encoder, texts):
    raw = [t.encode() for t in texts]
    parts = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([*map(len, raw)])))
    return [own.tolist() for _, _, ids, counts in parts for own in np.split(ids, np.cumsum(counts)[:-1])]


def some_texts():
    r = random.Random(5)
    tokens = [t.decode() for t in bpe_tokens() if all(b < 128 for b in t)]
    odd = lambda: chr(r.choice([r.randint(32, 126), r.randint(160, 0x2FF), r.randint(0x1F300, 0x1F600), 32, 10, 10, 9, 0x1C, 0x85, 0xA0, 0x3000]))
    return (
        ["a" * k for k in range(40)] + ["", "the  x \n y", "x\n\ny", "x\n \ny\n", "\nx", " x ", "x  ", "it's 'll  're", "\n" * 30, " " * 30, "<|endoftext|>"]
        + ["".join(r.choice("abcde") for _ in range(r.randint(1, 80))) for _ in range(800)]
        + ["".join(r.choice(tokens) for _ in range(r.randint(1, 30))) for _ in range(3000)]
        + ["".join(odd() for _ in range(r.randint(1, 40))) for _ in range(2000)]
    )


def bpe_tokens():
    with open(bpe.ranks_path(), "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f]


def test_ids_are_those_of_the_library(encoder, library):
    texts = some_texts()
    for text, ids in zip(texts, encoded(encoder, texts), strict=True):
        assert ids == library.encode_ordinary(text), text


def test_every_class_of_character(encoder, library):
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}.\n{chr(c)}\n" for c in [*range(0x3100), *range(0x3100, 0x110000, 61)] if not 0xD800 <= c < 0xE000]
    for text, ids in zip(texts, encoded(encoder, texts), strict=True):
        assert ids == library.encode_ordinary(text), text


def test_long_pretokens(encoder, library):
    """Many merges of one rank in one pre-token, lower pairs that arise in the middle included."""
    r = random.Random(6)
    tokens = [t.decode() for t in bpe_tokens() if t.isalpha() and t.isascii()]
    texts = ["".join(r.choice("abcdefghijklmnop") for _ in range(30_000)), "".join(r.choice(tokens) for _ in range(8_000)), "x" * 20_001, "ab" * 9_000, "thethe" * 3_000]
    for text, ids in zip(texts, encoded(encoder, texts), strict=True):
        assert ids == library._core_bpe.encode_single_piece(text.encode())


def test_long_pretoken_takes_linear_time(encoder):
    import time

    def seconds(n):
        r = random.Random(n)
        text = "".join(r.choice("abcdefghijklmnop") for _ in range(n))
        began = time.process_time()
        encoded(encoder, [text])
        return time.process_time() - began

    seconds(1000)
    assert seconds(800_000) < 12 * max(seconds(100_000), 0.1)


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMORY_PIECES", 50)
    monkeypatch.setattr(bpe, "ROUND_BYTES", 64)
    own = bpe.Encoder(bpe.Ranks.of(bpe.ranks_path()), bpe.split_pattern())
    texts = some_texts()[:900]
    for k in range(0, len(texts), 20):
        assert encoded(own, texts[k : k + 20]) == [library.encode_ordinary(t) for t in texts[k : k + 20]]
    assert len(own.stretches) < 2000


def test_rank_queue_gives_the_lowest_rank():
    r = random.Random(7)
    queue, want = bpe.RankQueue(70_000), {}
    for step in range(400):
        ranks = [r.randint(-1, 69_999) if r.random() < 0.7 else r.randint(0, 9) for _ in range(r.choice([1, 3, 90]))]
        positions = [step * 100 + k for k in range(len(ranks))]
        queue.push(np.array(positions, np.int32), np.array(ranks))
        for p, rank in zip(positions, ranks, strict=True):
            if rank >= 0:
                want.setdefault(rank, []).append(p)
        for _ in range(r.randint(0, 30)):
            assert queue.first() == min(want, default=-1)
            if want:
                rank = min(want)
                assert queue.take(rank).tolist() == sorted(want.pop(rank))


def test_lacking_bytes_are_an_error(tmp_path):
    (tmp_path / "few").write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(255)))
    with pytest.raises(ValueError, match="lacks 1"):
        bpe.Ranks(str(tmp_path / "few"))


@pytest.mark.parametrize("size", [40, 1 << 23])
def test_frames(spark, library, monkeypatch, size):
    monkeypatch.setattr(bpe, "SLICE_BYTES", size)
    texts = [None, "", "two words", "two words", "é　x  y\n\nz", "long " * 30_000, "x" * 5000, " \n", "123 'tis"]
    rows = [(k if k != 3 else None, t, "x", 1, 2) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    coded = bpe.encode_texts(docs)
    assert coded.columns == ["doc_id", "ids"]
    found = bpe.decode_ids(coded).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    for k, text, *_ in rows:
        t = text or ""
        assert by[k]["ids"] == library.encode_ordinary(t) and bytes(by[k]["decoded"]).decode() == t
    assert sorted(map(str, bpe.encode_texts(docs, decoded=True).collect())) == sorted(map(str, found))
    assert bpe.encode_texts(docs.limit(0)).count() == 0


def test_query(spark, library, tmp_path):
    rows = [(1, None, "x", 1, 2), (2, "Some words.\nAnd more", "x", 1, 2)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in bpe.op12_byte_bpe(spark, str(tmp_path)).collect()}
    for k, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        digests = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
        assert tuple(found[k]) == (k, len(ids), *digests)
