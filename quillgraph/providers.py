"""Text and embedding providers. The offline ones are deterministic; others can be passed where these are."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.state import written


class TextProvider(Protocol):
    """Answers to prompts: ``answer`` takes rows (key, prompt) and returns (key, payload)."""

    def answer(self, requests: DataFrame) -> DataFrame: ...


class EmbeddingProvider(Protocol):
    def embed(self, text: Column) -> Column: ...


class FirstSentence:
    """A prompt's first sentence as its answer: a placeholder for summaries and descriptions."""

    def answer(self, requests: DataFrame) -> DataFrame:
        return requests.select("key", F.left(F.regexp_extract("prompt", r"(?s)^\s*(.*?[.!?])(?:\s|$)", 1), F.lit(300)).alias("payload"))


def tokens_of(text: Column) -> Column:
    """Tokens that a text counts as where a provider doesn't say: one for four characters, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


class Chain:
    """Models in order of preference: what one leaves unanswered, after so many attempts, goes to the next.

    ``models``: (name, provider). A payload that is null or blank, or fails ``accept`` (a condition on it), is no answer.
    What a model says is written before the rest is asked for, so that no key is asked more often than its attempts. Answers have
    model, attempt, prompt_tokens and output_tokens, those of failed attempts included; a provider may return the
    token columns itself. A key that no model answers has no row in ``answer``, and its calls are in ``calls``.
    """

    def __init__(self, models: list[tuple[str, TextProvider]], attempts: int = 1, accept: Callable[[Column], Column] | None = None):
        self.models, self.attempts, self.accept = models, attempts, accept

    def calls(self, requests: DataFrame) -> DataFrame:
        """key, payload, model, attempt, prompt_tokens, output_tokens, answered: a row for each time that a model was asked."""
        left, parts = written(requests.select("key", "prompt").dropDuplicates(["key"]), "requests"), []
        for name, provider in self.models:
            for attempt in range(1, self.attempts + 1):
                said = provider.answer(left)
                more = [c for c in ("prompt_tokens", "output_tokens") if c in said.columns]
                rows = left.join(said.select("key", "payload", *[F.col(c).alias(f"_{c}") for c in more]).dropDuplicates(["key"]), "key", "left")
                good = F.trim(F.coalesce("payload", F.lit(""))) != ""
                good = good & F.coalesce(self.accept(F.col("payload")), F.lit(False)) if self.accept else good
                count = lambda c, text: F.coalesce(*([F.col(f"_{c}").cast("long")] if c in more else []), tokens_of(F.col(text))).alias(c)
                rows = rows.select("key", "prompt", "payload", F.lit(name).alias("model"), F.lit(attempt).alias("attempt"), count("prompt_tokens", "prompt"), count("output_tokens", "payload"), good.alias("answered"))
                rows = written(rows, "calls")
                parts.append(rows.drop("prompt"))
                left = rows.where(~F.col("answered")).select("key", "prompt")
                if left.isEmpty():
                    return reduce(DataFrame.unionByName, parts)
        return reduce(DataFrame.unionByName, parts)

    def answer(self, requests: DataFrame) -> DataFrame:
        calls = self.calls(requests)
        return calls.where("answered").select("key", "payload", "model", "attempt", "prompt_tokens", "output_tokens")


def usage(calls: DataFrame) -> DataFrame:
    """model, n_calls, n_answered, prompt_tokens, output_tokens."""
    return calls.groupBy("model").agg(F.count("*").alias("n_calls"), F.count_if("answered").alias("n_answered"), *[F.sum(c).alias(c) for c in ("prompt_tokens", "output_tokens")])


class HashedTerms:
    """Counts of a text's tokens in hashed slots; equal texts are near, others rarely."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, text: Column) -> Column:
        slots = F.transform(T.tokens(F.coalesce(text, F.lit(""))), lambda w: F.pmod(F.xxhash64(w), F.lit(self.dimensions)))
        count = lambda k: F.size(F.filter(slots, lambda s: s == k)).cast("float")
        return F.transform(F.sequence(F.lit(0), F.lit(self.dimensions - 1)), count)
