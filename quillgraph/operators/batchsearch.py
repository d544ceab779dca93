"""The best nodes of many queries at once, by words: blocks of nodes against blocks of queries.

Each of n queries meets a fixed share of all nodes, so there are some n² pairs, of which only the best few a query count.
A pair is never a row here: a task holds the postings of one block of nodes and the words of one block of queries, both of
fixed size, sums a query's scores over the block, and returns its best nodes only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT, EngineConfig
from quillgraph.state import written

#: Nodes and queries of a block.
NODES, QUERIES = 1 << 16, 1 << 13


def weighted_words(counts: DataFrame, n: int, length: int, asked: DataFrame, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """postings (node_id, word: a number, s: what it adds to BM25) of the words that are asked for, and asked (query_id, word).

    counts: node_id, dl, word, tf, at least for these words; n and length: nodes, and words of all nodes, that count; asked: query_id, word.
    """
    asked = asked.select("query_id", "word").distinct()
    df = counts.join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    idf = written(df.select("word", F.monotonically_increasing_id().alias("_id"), F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "idf")
    norm = config.bm25_k1 * (1 - config.bm25_b + config.bm25_b * F.col("dl") / F.lit(length / max(n, 1)))
    s = F.col("idf") * F.col("tf") * (config.bm25_k1 + 1) / (F.col("tf") + norm)
    return counts.join(idf, "word").select("node_id", F.col("_id").alias("word"), s.alias("s")), asked.join(idf, "word").select("query_id", F.col("_id").alias("word"))


def _summed(postings: pd.DataFrame, asked: pd.DataFrame) -> Iterator[tuple]:
    """Of each query that meets the block: its first row in ``asked``, nodes in ascending order, their BM25 and how many of its words they have.

    A node's terms are added in the order of the query's words, so nodes of equal words have equal scores.
    """
    postings = postings.sort_values("word", kind="stable")
    asked = asked.sort_values(["query_id", "word"])
    nodes, at = np.unique(postings["node_id"].to_numpy(), return_inverse=True)
    word, s, wanted = postings["word"].to_numpy(), postings["s"].to_numpy(), asked["word"].to_numpy()
    low, high = np.searchsorted(word, wanted, "left"), np.searchsorted(word, wanted, "right")
    ids = asked["query_id"].to_numpy()
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(ids)]):
        spans = [slice(x, y) for x, y in zip(low[a:b], high[a:b]) if x < y]
        if spans:
            met = np.concatenate([at[x] for x in spans])
            words = np.bincount(met, minlength=len(nodes))
            some = np.flatnonzero(words)
            yield asked.iloc[a], nodes[some], np.bincount(met, np.concatenate([s[x] for x in spans]), len(nodes))[some], words[some]


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """The k best, ties to the first."""
    if len(score) > k:
        least = np.partition(score, -k)[-k]
        above, equal = np.flatnonzero(score > least), np.flatnonzero(score == least)
        return np.r_[above, equal[: k - len(above)]]
    return np.arange(len(score))


def best_pairs(postings: DataFrame, asked: DataFrame, n: int, weights: list[tuple[float, float]], depth: int, nodes: int = NODES, queries: int = QUERIES) -> DataFrame:
    """query_id, node_id, fulltext (BM25), words (share of the query's words) of the pairs that can be among a query's ``depth`` best by
    some of the weights of (fulltext, words), each over its greatest value of the query; ties to the smaller node_id.

    The best of each block of nodes are returned, which hold the best of all. n: nodes, from which the number of blocks follows.
    """
    many = asked.select("query_id").distinct().count()
    n_blocks, q_blocks = max(-(-n // nodes), 1), max(-(-many // queries), 1)
    block = lambda key, of: F.pmod(F.xxhash64(key), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    keys = ["nb", "qb"]
    left = postings.select(block("node_id", n_blocks).alias("nb"), every(q_blocks).alias("qb"), "node_id", "word", "s").repartition(n_blocks * q_blocks, *keys)
    kind = dict(postings.dtypes)["node_id"]
    query_kind = dict(asked.dtypes)["query_id"]

    def run(rows: DataFrame, of: Callable, schema: str) -> DataFrame:
        right = rows.select(block("query_id", q_blocks).alias("qb"), every(n_blocks).alias("nb"), *rows.columns).repartition(n_blocks * q_blocks, *keys)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(of, schema)

    def most(_postings: pd.DataFrame, _asked: pd.DataFrame) -> pd.DataFrame:
        found = [(q["query_id"], s.max(), int(c.max())) for q, _, s, c in _summed(_postings, _asked)] if len(_postings) and len(_asked) else []
        return pd.DataFrame(found, columns=["query_id", "s", "c"])

    top = run(asked, most, f"query_id {query_kind}, s double, c long").groupBy("query_id").agg(F.max("s").alias("top_s"), F.max("c").alias("top_c"))
    rows = asked.join(written(top, "most"), "query_id").join(asked.groupBy("query_id").agg(F.count("*").alias("n_words")), "query_id")
    # Each measure's own best are among the pairs, so that their greatest values are as well.
    weights = sorted({(1.0, 0.0), (0.0, 1.0), *weights} - {(0.0, 0.0)})
    columns = ["query_id", "node_id", "fulltext", "words"]

    def best(_postings: pd.DataFrame, _asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        for q, ids, s, c in _summed(_postings, _asked) if len(_postings) and len(_asked) else ():
            share = c / q["n_words"]
            a, b = s / q["top_s"], share / (q["top_c"] / q["n_words"])
            kept = np.unique(np.concatenate([_first(x * a + y * b, depth) for x, y in weights]))
            found.append((np.full(len(kept), q["query_id"]), ids[kept], s[kept], share[kept]))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(columns, zip(*found))} if found else {c: [] for c in columns})

    return written(run(rows, best, f"query_id {query_kind}, node_id {kind}, fulltext double, words double"), "pairs")
