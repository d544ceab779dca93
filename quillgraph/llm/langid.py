"""Language identification with string kernels.

Kernel: the blended-spectrum presence kernel, the number of character n-grams (lengths ``ORDERS``) that two texts
share, divided by the geometric mean of their own numbers. Texts are lower-cased, digits and punctuation count as
spaces. N-grams are hashed to ``DIMENSIONS`` slots, so a text is a bit vector and a kernel value a product of two.

Fit: of the labelled rows of the training folds, about ``SAMPLE_PER_LANG`` of each
language (rows whose hash falls below the rate that gives so many) are turned to bit vectors by the executors;
of these ``LANDMARKS`` are the Nyström landmarks. On the map K(x, L) K(L, L)^(-1/2), kernel ridge regression is solved
for each language against the rest. Tasks return sums of kernel rows over the sample, so the driver holds matrices of
landmarks by landmarks and never the sample. These numbers are the bound of the sample; prediction covers every whole
text.

Prediction: a batch of bit vectors times landmarks and weights. Both factors are linear in the bit vector, so their
product is taken once and a batch takes one matrix product of texts by slots and slots by languages.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; null languages are not learned; with no
labelled row every text is ``und``; with one language all texts get it; a language of one labelled row is learned; rows of
null doc_id train too; repeated rows count once in the sample and are predicted alike; equal scores go to the first
language in order; a very long text is one vector as any other (most slots of it may be set); an empty table gives an empty
result; further columns are kept by ``with_language``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import materialise, small_batches, table

ORDERS = (1, 2, 3, 4)
DIMENSIONS = 1 << 14
SAMPLE_PER_LANG = 400
LANDMARKS = 300
#: Sampled rows that one task sums.
TASK_ROWS = 4096
RIDGE = 0.0005
#: The value of all learned texts is near 1 for a text of any learned language, or of several, and near 0 for one whose
#: n-grams none has. A text of at least so many letters is rejected below this value.
LEAST_VALUE = 0.5
LEAST_LETTERS = 200
NO_LANGUAGE = "und"

_FOLD = np.frombuffer(bytes(range(256)), np.uint8).copy()
for _c in range(128):
    _FOLD[_c] = ord(chr(_c).lower()) if chr(_c).isalpha() else 32


def _bits(text: str) -> np.ndarray:
    """Slots of the n-grams of a whole text (distinct)."""
    codes = _FOLD[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    if len(codes) > 1:  # runs of spaces count as one
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        codes = codes[keep]
    seen = np.zeros(DIMENSIONS, np.bool_)
    roll = np.zeros(len(codes), np.uint32)
    for n in ORDERS:
        if len(codes) < n:
            break
        roll = roll[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
        slot = (roll ^ np.uint32(n)) * np.uint32(0x9E3779B1)
        seen[slot >> np.uint32(32 - 14)] = True
    return seen


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [np.packbits(_bits(text)).tobytes() for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], ["lang", "draw", "bits"])


def _unit(bits: np.ndarray) -> np.ndarray:
    """Bit vectors over the root of their number of bits: products of these are kernel values."""
    x = bits.astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    return x


def _unpack(packed: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1)


def _sums(marks: list[bytes], weight: dict[str, float]):
    """One row a task: K'WK over its rows of the sample, and the weighted sum of kernel rows of each language."""
    order = {lang: k for k, lang in enumerate(weight)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _unit(_unpack(marks))
        gram, sums = np.zeros((len(marks), len(marks))), np.zeros((len(order), len(marks)))
        for batch in batches:
            langs = batch.column(0).to_pylist()
            rows = (_unit(_unpack(batch.column(1).to_pylist())) @ known.T).astype(np.float64)
            weighted = rows * np.array([weight[y] for y in langs])[:, None]
            gram += rows.T @ weighted
            np.add.at(sums, [order[y] for y in langs], weighted)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], ["gram", "sums"])

    return run


class Model:
    """Languages, and for each, and at last for any of them, a weight of every slot: landmarks and ridge weights multiplied out."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    @classmethod
    def solve(cls, languages: list[str], marks: np.ndarray, gram: np.ndarray, sums: np.ndarray) -> Model:
        """Ridge weights from what the tasks summed: K'WK, and for each language the weighted sum of its kernel rows.

        Targets are 1 for a language's own rows and -1 for the rest, so K'Wy is twice its own sum less all sums. The last
        column has the target 1 for every row: it is near 1 for texts of any learned language, near 0 for others.
        """
        marks = _unit(marks)
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        good = values > 1e-5 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        held = root.T @ gram @ root + RIDGE * np.eye(root.shape[1])
        total = sums.sum(axis=0)
        solved = np.linalg.solve(held, root.T @ np.vstack([2 * sums - total, total]).T)
        return cls(languages, marks.T @ (root @ solved).astype(np.float32))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, score from 0 to 1, and the ridge value of all learned texts, which is near 1 for texts like those."""
        if not self.languages or not texts:
            return [NO_LANGUAGE] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        values = (_unit(np.stack([_bits(text) for text in texts])) @ self.weights).astype(np.float64)
        scores = values[:, :-1]
        best = scores.argmax(axis=1)
        power = np.exp(3.0 * (scores - scores.max(axis=1, keepdims=True)))
        return [self.languages[k] for k in best], (1.0 / power.sum(axis=1)).tolist(), values[:, -1].tolist()


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Fits on a bounded sample of the labelled rows outside the held-out fold.

    The driver gets LANDMARKS bit vectors of two kB, and a LANDMARKS x LANDMARKS matrix from each of a few tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # Repeated rows draw alike and count as one; the least draw of a language is always in.
    rows = rows.select("lang", "text", (F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 40)) / F.lit(2.0**40)).alias("draw"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")).orderBy(F.desc("n"), "lang").collect()  # a row a language
    if not counts:
        return Model([], np.zeros((DIMENSIONS, 0), np.float32))
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], max(min(1.0, SAMPLE_PER_LANG / r["n"]), np.nextafter(r["least"], 2).item()))])
    sample = rows.where(F.col("draw") < F.element_at(rate, F.col("lang"))).mapInArrow(_vectors, "lang string, draw double, bits binary")
    sample = materialise(sample.groupBy("lang", "draw").agg(F.min("bits").alias("bits")), "sample")
    shares = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(shares)
    # Landmarks in turn from each language.
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    marks = [bytes(r["bits"]) for r in sample.withColumn("turn", turn).orderBy("turn", "draw", "lang").limit(LANDMARKS).select("bits").collect()]
    # Each language weighs the same, however many of its rows the sample has; all weights add up to one a language.
    weight = {y: 1.0 / shares[y] for y in languages}
    tasks = -(-sum(shares.values()) // TASK_ROWS)
    found = sample.select("lang", "bits").repartition(tasks).mapInArrow(_sums(marks, weight), "gram binary, sums binary").collect()
    gram = sum(np.frombuffer(r["gram"]).reshape(len(marks), -1) for r in found)
    sums = sum(np.frombuffer(r["sums"]).reshape(len(languages), -1) for r in found)
    return Model.solve(languages, _unpack(marks), gram, sums)


def _predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Languages, scores and ridge values of whole texts; those without a letter are not asked for."""
    asked = [k for k, text in enumerate(texts) if text and any(map(str.isalpha, text))]
    langs, scores, values = [NO_LANGUAGE] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    for k, lang, score, value in zip(asked, *model.predict([texts[k] for k in asked]), strict=True):
        langs[k], scores[k], values[k] = lang, score, value
    return langs, scores, values


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and lang_score to every document; other columns pass through, those of these names are replaced."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS weights a language
    docs = docs.drop("lang_pred", "lang_score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, _ = _predict(held.value, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def known(model: Model, texts: list[str | None], least_value: float = LEAST_VALUE, least_letters: int = LEAST_LETTERS) -> list[bool]:
    """Whether some learned language fits each text; one of few letters has too few n-grams to tell, and any fits."""
    langs, _, values = _predict(model, texts)
    return [
        y != NO_LANGUAGE and (v >= least_value or sum(map(str.isalpha, text)) < least_letters)
        for text, y, v in zip(texts, langs, values, strict=True)
    ]


def with_known_language(docs: DataFrame, model: Model, least_value: float = LEAST_VALUE, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """The documents that some learned language fits; all columns as they are. Without a learned language none is left."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known(held.value, batch.column(at).to_pylist(), least_value, least_letters), pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def op2_language_kernels(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = with_language(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
