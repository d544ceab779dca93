"""Token-ID output: documents to wavelet-matrix files, and back.

Documents are dealt by ranges of doc_id and sorted; each task encodes its texts and closes a shard at
``SHARD_TOKENS`` ids, always at the end of a document. A shard is one row of its own Parquet file, written by Spark's
committer to any store that Spark reaches: its document table (ids, token counts) and one compressed wavelet matrix
(see ``wavelet.py``). ``read_documents`` decodes the files; ``start`` counts the ids of all earlier documents.

The ids of a text are those of the tokenizers library over the whole text. White space always ends a word of the
vocabulary's splitting pattern, so a text is encoded word by word and words met before come from a bounded table.

Defined cases: a null or empty text is the end id alone; a null doc_id comes first; repeated rows are documents of
their own, in unspecified order among themselves; an empty table gives no files and an empty result; further columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import fresh_path, small_batches, table, whole_text
from quillgraph.llm.wavelet import WaveletMatrix, dump

#: Ids after which a shard closes; a longer document is a shard by itself.
SHARD_TOKENS = 1 << 21
#: Words that a worker remembers.
MEMORY_WORDS = 800_000
END_ID = 1

SHARD_SCHEMA = "part int, seq int, n_docs long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, payload binary"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts; remembers words as bytes of little-endian ids."""

    _known: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bits = max(int(max(vocab.values())), END_ID).bit_length()
        self.kind = np.dtype("<u2") if self.bits <= 16 else np.dtype("<u4")
        self.ends = np.zeros(1 << self.bits, bool)
        self.ends[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {"": b""}
        self.marks = {m: self._raw([m])[0] for m in (".", ",")}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One per worker process, so that later tasks find the words of earlier ones."""
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def _raw(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in found]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of lower-case letters only: encoded as one text and parted where a word ends."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=self.kind)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self._raw(words)
        raw, w, last = ids.tobytes(), self.kind.itemsize, 0
        out = []
        for cut in (cuts * w).tolist():
            out.append(raw[last:cut])
            last = cut
        return out

    def learn(self, missing: set[str]) -> None:
        words = self.words
        if len(words) + len(missing) > MEMORY_WORDS:
            # Words met first are the common ones: the later half goes.
            for word in list(islice(words, MEMORY_WORDS // 2, None)):
                del words[word]
        plain, odd = {}, []
        for word in missing:
            stem = word[:-1] if word[-1:] in (".", ",") else word
            low = stem.lower()
            # A lone sigma or a dotted capital lowers by its surroundings: the library decides.
            if low.isalpha() and len(low) == len(stem) and "Σ" not in stem:
                plain[word] = low
            else:
                odd.append(word)
        new = [low for low in dict.fromkeys(plain.values()) if low not in words]
        words.update(zip(new, self._letters(new), strict=True))
        marks = self.marks
        for word, low in plain.items():
            words[word] = words[low] + marks[word[-1]] if word[-1] in marks else words[low]
        if odd:
            words.update(zip(odd, self._raw(odd), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has. A word of the batch is looked up once."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        # All words as one string, which is parted faster than an Arrow array; no word has a line break.
        whole = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        words = pc.binary_join(whole, "\n")[0].as_py().split("\n") if len(coded.dictionary) else []
        codes = coded.indices.to_numpy()
        pieces = list(map(self.words.get, words))
        missing = {word for word, piece in zip(words, pieces, strict=True) if piece is None}
        if missing:
            self.learn(missing)
            pieces = [self.words[word] if piece is None else piece for word, piece in zip(words, pieces, strict=True)]
        flat = np.frombuffer(b"".join(pieces), self.kind)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.kind.itemsize
        starts, many = np.cumsum(sizes) - sizes, sizes[codes]
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = flat[np.repeat(starts[codes] - ends[:-1], many) + np.arange(ends[-1])]
        return ids, np.diff(ends[parts.offsets.to_numpy()])


def _shards(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        part, seq = TaskContext.get().partitionId(), 0
        held = 0
        ids: list[int | None] = []
        lengths: list[int] = []
        bodies: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            payload = dump(np.concatenate(bodies), encoder.bits)
            columns = [[part], [seq], [len(ids)], [held], [ids[:]], [lengths[:]], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "seq", "n_docs", "n_tokens", "doc_ids", "doc_tokens", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            found, many = encoder.encode(batch.column(1))
            ends = np.cumsum(many)
            found = np.insert(found, ends, END_ID)  # an end id after each document
            many, done = many + 1, 0
            upto = np.cumsum(many)
            for k, (doc_id, n) in enumerate(zip(batch.column(0).to_pylist(), many.tolist(), strict=True)):
                ids.append(doc_id)
                lengths.append(n)
                held += n
                if held >= SHARD_TOKENS:
                    bodies.append(found[done : upto[k]])
                    yield close()
                    seq, held, done = seq + 1, 0, int(upto[k])
                    ids, lengths, bodies = [], [], []
            if done < len(found):
                bodies.append(found[done:])
        if ids:
            yield close()

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> None:
    """Writes one file for each shard."""
    small_batches(docs.sparkSession)
    (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
        .mapInArrow(_shards(tokenizer), SHARD_SCHEMA)
        .write.option("maxRecordsPerFile", 1)
        .option("compression", "uncompressed")
        .parquet(out)
    )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "seq", "pos", "doc_id", "local_start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for row in batch.to_pylist():
            ids = WaveletMatrix.load(row["payload"]).decode().astype("<u4")
            sizes = np.array(row["doc_tokens"], dtype=np.int64)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(sizes)
            columns = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(range(n), pa.int64()),
                       pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(sizes), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, part, seq of every document, decoded from the files."""
    small_batches(spark)
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    docs = shards.select("part", "seq", "doc_ids", "doc_tokens", "payload").mapInArrow(
        _documents, "part int, seq int, pos long, doc_id long, local_start long, n_tokens long, ids_crc32 long"
    )
    # Ids before a shard: those of earlier parts (one row a part), then of earlier shards of its part.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inner")).join(parts, "part")
    bases = bases.select("part", "seq", (F.col("base") + F.col("inner")).alias("base"))
    return docs.join(bases, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "part", "seq"
    )


def encode_documents(docs: DataFrame, tokenizer: str | None = None, out: str | None = None) -> DataFrame:
    """Writes the files, then returns their documents."""
    spark = docs.sparkSession
    out = out or fresh_path(spark, "tokens")
    write_tokens(docs, out, tokenizer or tokenizer_path())
    return read_documents(spark, out)


def op5_wavelet_tokens(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")
