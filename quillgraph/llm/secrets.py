"""Secret scans with DataFrame functions only: three fixed patterns, and character Markov models.

Base spans come from the patterns below. Every other run of secret-like characters that holds a digit is a candidate
and is scored by two first-order Markov models over characters, one of random strings and one of ordinary identifiers:
the mean log-likelihood ratio of its character pairs. Above ``LEAST_RATIO`` it is a secret too.

Training: random strings are hex, base32-like and base64 spellings of digests, and the secrets that the patterns find in
the training documents; ordinary identifiers are the words of those documents, alone, joined and with a number. The
sample is bounded by ``TRAIN_DOCS`` documents of ``TRAIN_WORDS`` words and ``TRAIN_STRINGS`` digests; scanning covers every whole text.

Spans are found by marking each match and adding up the lengths between marks, so they count code points. The marks
are private-use characters; where a text has those itself they are read as a replacement character of the same length,
which no pattern takes.

Defined cases: a null text counts as empty and has no spans; repeated rows are scanned each; candidates that overlap a
base span are dropped, not cut; with no training text the models see the digests only; an empty table gives an empty
result; further columns are kept by ``scan_secrets``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import table, whole_text

#: The base patterns, and the fewest characters of the secret (of the match, but for ``assign``).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "markov")

#: Candidates of the Markov models.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Mean log-likelihood ratio per character pair from which a candidate is a secret.
LEAST_RATIO = 1.75
TRAIN_DOCS = 2000
TRAIN_STRINGS = 3000
#: Words that the sample takes of one training document.
TRAIN_WORDS = 400
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

_OPEN, _SPLIT, _TAKEN = "\ue000", "\ue001", "\ue002"
_SPAN = "array<struct<start:long,end:long>>"
_FOUND = "array<struct<start:long,end:long,string:string>>"


#: Parts that one fold goes over: a list that grows is copied at each step, so it stays short.
FOLD = 128


def _clean(text: Column) -> Column:
    return F.translate(text, _OPEN + _SPLIT + _TAKEN, "\ufffd\ufffd\ufffd")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _marked(text: Column, pattern: str, group: int) -> Column:
    """What lies between matches, split: each part but the first is match SPLIT measured SPLIT rest."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_OPEN}$0{_SPLIT}${group}{_SPLIT}")), _OPEN)


def _marked_spans(parts: Column, least: int) -> Column:
    """Spans (start, end, string) from the parts of ``_marked``, by sums over runs of ``FOLD`` parts and then within each."""

    def measured(part: Column) -> Column:
        pieces = F.split(part, _SPLIT)
        return F.struct(pieces[0].alias("string"), F.length(pieces[0]).alias("n"), (F.length(pieces[0]) + F.length(pieces[2])).alias("all"), (F.length(pieces[1]) >= least).alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        longer = F.array_append(acc["out"], F.struct(acc["at"].alias("start"), (acc["at"] + x["n"]).alias("end"), x["string"].alias("string")))
        return F.struct((acc["at"] + x["all"]).alias("at"), F.when(x["ok"], longer).otherwise(acc["out"]).alias("out"))

    def spans(parts: Column) -> Column:
        rows = F.transform(F.slice(parts, 2, F.size(parts)), measured)
        first = F.length(F.element_at(parts, 1)).cast("long")
        runs = lambda rows: F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / FOLD)), lambda k: F.slice(rows, (k * FOLD + 1).cast("int"), F.lit(FOLD)))
        total = lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda n, x: n + x["all"])
        zero = lambda at: F.struct(at.alias("at"), F.array().cast(_FOUND).alias("out"))

        def placed(runs: Column) -> Column:
            begin = F.struct(first.alias("at"), F.array().cast("array<long>").alias("out"))
            starts = F.aggregate(F.transform(runs, total), begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]
            return F.flatten(F.zip_with(runs, starts, lambda run, at: F.aggregate(run, zero(at), step)["out"]))

        return _let(rows, lambda rows: F.when(F.size(rows) > 0, _let(runs(rows), placed)).otherwise(F.array().cast(_FOUND)))

    return _let(parts, spans)


def pattern_spans(text: Column, pattern: str, least: int, group: int = 0) -> Column:
    """Leftmost matches that don't overlap, those whose measured group is shorter than ``least`` dropped."""
    return F.when(text.rlike(pattern), _marked_spans(_marked(text, pattern, group), least)).otherwise(F.array().cast(_FOUND))


def _taken(text: Column, pattern: str, least: int, group: int = 0) -> Column:
    """The text with TAKEN for each character of the spans of a pattern."""
    shown = lambda pieces: F.concat(F.when(F.length(pieces[1]) >= least, F.repeat(F.lit(_TAKEN), F.length(pieces[0]))).otherwise(pieces[0]), pieces[2])
    joined = _let(_marked(text, pattern, group), lambda parts: F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), lambda p: shown(F.split(p, _SPLIT))), "")))
    return F.when(text.rlike(pattern), joined).otherwise(text)


#: kind: pattern, fewest characters, measured group. A run of AKIA or hex characters is matched whole, so short ones are passed over without marking them.
BASE = {"assign": (ASSIGN, ASSIGN_LEAST, 2), "access": (f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}", ACCESS_LEAST, 0), "hex": (f"[0-9a-f]{{{HEX_LEAST},}}", HEX_LEAST, 0)}


def base_spans(text: Column) -> dict[str, Column]:
    return {kind: F.transform(pattern_spans(text, *rule), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for kind, rule in BASE.items()}


def _labelled_samples(docs: DataFrame) -> DataFrame:
    """label (1 random, 0 ordinary) and string."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    upper = F.upper(F.translate(F.substring(base64, 1, 32), "+/=", "234"))
    made = spark.range(TRAIN_STRINGS).select(F.explode(F.array(F.substring(digest, 1, 40), base64, upper)).alias("string"), F.lit(1).alias("label"))
    # A bounded sample: TRAIN_DOCS documents at most, those with the smallest draws. Only ids are ranked; the texts of
    # the chosen ones are found again by a join with that bounded list.
    named = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    chosen = named.select("doc_id").orderBy(F.crc32(F.concat(F.lit("secrets:"), F.col("doc_id").cast("string"))), "doc_id").limit(TRAIN_DOCS)
    sample = named.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").select("text")
    found = sample.select(F.explode(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).alias("string")).where(F.length("string") >= ASSIGN_LEAST)
    found = found.unionByName(sample.select(F.explode(F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0))).alias("string")))
    words = sample.select(F.slice(F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)), lambda w: F.length(w) < 24), 1, TRAIN_WORDS).alias("w"))
    number = F.pmod(F.hash("word"), F.lit(1000)).cast("string")
    words = words.select(F.posexplode("w").alias("k", "word"), "w")
    spellings = F.array("word", F.concat(F.lower("word"), F.lit("_"), F.lower(F.get("w", F.col("k") + 1))), F.concat("word", number), F.concat("word", F.lit("-"), F.initcap(F.get("w", F.col("k") + 1)), F.lit("_"), number))
    ordinary = words.select(F.explode(spellings).alias("string"), F.lit(0).alias("label")).where(F.col("string").isNotNull())
    return made.unionByName(found.withColumn("label", F.lit(1))).unionByName(ordinary)


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of ALPHABET characters (row: first, column: second), add-one smoothed."""
    pairs = _labelled_samples(docs).select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("string") - 1), lambda i: F.substring("string", i, F.lit(2)))).alias("pair"))
    rows = pairs.where(F.length("pair") == 2).groupBy("label", "pair").agg(F.count("*").alias("n")).collect()  # at most 2 * len(ALPHABET) ** 2 of the alphabet
    n = len(ALPHABET)
    counts = [[1.0] * (n * n), [1.0] * (n * n)]
    for r in rows:
        a, b = ALPHABET.find(r["pair"][0]), ALPHABET.find(r["pair"][1])
        if a >= 0 and b >= 0:
            counts[r["label"]][a * n + b] += r["n"]
    out = []
    for a in range(n):
        totals = [sum(c[a * n : (a + 1) * n]) for c in counts]
        out += [math.log(counts[1][a * n + b] / totals[1]) - math.log(counts[0][a * n + b] / totals[0]) for b in range(n)]
    return [round(x, 6) for x in out]


def mean_ratio(string: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a string's character pairs; reads each character once."""
    ratios = F.from_json(F.lit(json.dumps(model)), "array<double>")  # folded to one literal
    codes = F.transform(F.slice(F.split(string, ""), F.lit(1), F.length(string)), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = lambda codes: F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.element_at(ratios, (a - 1) * len(ALPHABET) + b))
    total = _let(codes, lambda codes: F.aggregate(pairs(codes), F.lit(0.0), lambda acc, x: acc + x))
    return total / (F.length(string) - 1)


def scan_secrets(docs: DataFrame, model: list[float]) -> DataFrame:
    """Adds assign, access, hex and markov: arrays of spans (code points, end exclusive)."""
    docs = docs.withColumn("_clean", _clean(whole_text()))
    docs = docs.withColumns(base_spans(F.col("_clean")))
    # A candidate goes over what base spans took; one that holds any of it is dropped. All of a base span that isn't
    # taken yet when its pattern comes is in one run with what is, so the patterns are taken in turn.
    left = F.col("_clean")
    for kind, rule in BASE.items():
        left = F.when(F.size(kind) > 0, _taken(left, *rule)).otherwise(left)
    docs = docs.withColumn("_left", F.when(F.size("assign") + F.size("access") + F.size("hex") > 0, left).otherwise(F.col("_clean")))
    runs = pattern_spans(F.col("_left"), CANDIDATE.replace("A-Z", "A-Z" + _TAKEN), 0)
    secret = lambda s: F.when(s["string"].rlike("[0-9]") & ~s["string"].contains(_TAKEN), mean_ratio(s["string"], model) >= LEAST_RATIO).otherwise(F.lit(False))
    # A candidate run with a digit: tested first, so that plain texts are done with one pass.
    likely = F.col("_clean").rlike(r"(?=[A-Za-z+/_=-]{0,200}[0-9])[A-Za-z0-9+/_=-]{20}")
    found = F.transform(F.filter(runs, secret), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    docs = docs.withColumn("markov", F.when(likely, found).otherwise(F.array().cast(_SPAN)))
    return docs.drop("_clean", "_left")


def spans_text(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""
    def keyed(k: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))

    names = F.array(*[F.lit(k) for k in kinds])
    said = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(F.concat(*[keyed(k, kind) for k, kind in enumerate(kinds)])), said), ",")


def op10_secret_models(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, train(docs))
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(spans_text(KINDS[:3]), 256).alias("base_sha256"),
        spans_text(KINDS).alias("spans"),
    )
