"""Candidate phases of hybrid retrieval. Each returns node_id, score and what later phases need, best first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT, EngineConfig
from quillgraph.functions import text as T
from quillgraph.functions import vector as V


def top(df: DataFrame, k: int, score: str = "score", key: str = "node_id") -> DataFrame:
    """The k best, ties to the smaller key."""
    return df.orderBy(F.desc(score), key).limit(k)


def bm25_scores(nodes: DataFrame, terms: list[str], content: str = "content", config: EngineConfig = DEFAULT) -> DataFrame:
    """node_id, the other columns, and BM25 score of every node with a term.

    Words are counted where the texts lie, so a node is one small row in the one shuffle, which statistics (one row,
    sent around) and scores both read. Columns of ``nodes`` but the text should be few.
    """
    extra = [c for c in nodes.columns if c != content]
    words = nodes.select(*extra, F.explode(T.long_words(F.col(content))).alias("_w")).where(~F.col("_w").isin(T.STOPWORDS))
    counted = words.groupBy(*extra).agg(F.count("*").alias("_dl"), *[F.count_if(F.col("_w") == t).alias(f"_t{k}") for k, t in enumerate(terms)])
    n = nodes.agg(F.count("*").alias("_n"))
    sums = counted.agg(F.sum("_dl").alias("_len"), *[F.count_if(F.col(f"_t{k}") > 0).alias(f"_d{k}") for k in range(len(terms))])
    stats = sums.crossJoin(F.broadcast(n)).withColumn("_avg", F.col("_len") / F.col("_n"))
    joined = counted.where(F.greatest(F.lit(0), *[F.col(f"_t{k}") for k in range(len(terms))]) > 0).crossJoin(F.broadcast(stats))
    score: Column = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.log(1 + (F.col("_n") - F.col(f"_d{k}") + 0.5) / (F.col(f"_d{k}") + 0.5))
        norm = config.bm25_k1 * (1 - config.bm25_b + config.bm25_b * F.col("_dl") / F.col("_avg"))
        score = score + idf * F.col(f"_t{k}") * (config.bm25_k1 + 1) / (F.col(f"_t{k}") + norm)
    return joined.select(*extra, score.alias("score"))


def bm25_fields(nodes: DataFrame, fields: list[str], terms: list[str], k: int, config: EngineConfig = DEFAULT) -> DataFrame:
    """Top k by the sum of the fields' BM25 scores, each field with statistics of its own."""
    parts = [bm25_scores(nodes.select("node_id", F.col(field).alias("content")), terms, config=config) for field in fields]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return top(rows.groupBy("node_id").agg(F.sum("score").alias("score")).where("score > 0"), k)


def bm25_topk(nodes: DataFrame, terms: list[str], k: int, keep: Column | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Top 2k first, then the date filter ``keep``, then k: later rows don't fill up what the filter takes."""
    found = top(bm25_scores(nodes, terms, config=config).where("score > 0"), 2 * k)
    return top(found if keep is None else found.where(keep), k)


def term_overlap(nodes: DataFrame, terms: list[str], k: int, content: str = "content") -> DataFrame:
    """Share of the terms that occur in the text, as substrings."""
    low = F.lower(F.coalesce(F.col(content), F.lit("")))
    hits = sum((low.contains(t).cast("int") for t in terms), F.lit(0))
    return top(nodes.withColumn("score", hits / F.lit(float(max(len(terms), 1)))).where("score > 0"), k)


def tag_expansion(nodes: DataFrame, exact: list[str], ancestors: dict[str, float], types: list[str], k: int) -> DataFrame:
    """Nodes by overlap of ``tags`` with a query's tags and their ancestors (at their mean weight), and of ``types``."""
    more = {t: w for t, w in ancestors.items() if t not in exact}
    weight = sum(more.values()) / len(more) if more else 0.3
    strings = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    shared = lambda column, values: F.size(F.array_intersect(F.coalesce(F.col(column), strings([])), strings(values)))
    score = (shared("tags", exact) + shared("tags", list(more)) * weight) / max(len(set(exact)) + len(more), 1) + 0.2 * shared("types", types) / max(len(types), 1)
    found = nodes.where(shared("tags", exact) + shared("tags", list(more)) > 0).withColumn("score", score)
    return top(found, k)


def entity_pivot(mentions: DataFrame, slugs: DataFrame, seen: DataFrame | None, k: int, adamic_adar: DataFrame | None = None) -> DataFrame:
    """Nodes that mention the query's entities: share of the slugs that a node has, plus 0.2 of the strongest Adamic-Adar tie.

    mentions: node_id, slug; slugs: slug (a query's few); seen: node_id to leave out; adamic_adar: slug, other, weight.
    """
    slugs = slugs.distinct()
    total = slugs.agg(F.count("*").alias("_n"))
    hit = mentions.join(slugs, "slug", "left_semi").groupBy("node_id").agg(F.countDistinct("slug").alias("shared"))
    if seen is not None:
        hit = hit.join(seen.select("node_id").distinct(), "node_id", "left_anti")
    hit = hit.crossJoin(F.broadcast(total)).withColumn("score", F.col("shared") / F.col("_n")).drop("_n")
    if adamic_adar is not None:
        ties = adamic_adar.join(slugs, "slug").select(F.col("other").alias("slug"), "weight")
        best = mentions.join(ties, "slug").groupBy("node_id").agg(F.max("weight").alias("_aa"))
        hit = hit.join(best, "node_id", "left").withColumn("score", F.col("score") + 0.2 * F.coalesce("_aa", F.lit(0.0))).drop("_aa")
    return top(hit, k)


def vector_topk(nodes: DataFrame, query: list[float], k: int, embedding: str = "embedding") -> DataFrame:
    """Nodes of positive cosine with the query vector; rows without an embedding have none."""
    score = V.cosine(F.col(embedding), V.literal(query))
    return top(nodes.where(F.col(embedding).isNotNull()).withColumn("score", score).drop(embedding).where("score > 0"), k)


def cluster_summaries(clusters: DataFrame, terms: list[str], k: int) -> DataFrame:
    """Clusters whose summary holds terms (``node_id``, ``summary``)."""
    return term_overlap(clusters, terms, k, content="summary")


def cross_document(
    similar: DataFrame, paragraphs: DataFrame, seeds: DataFrame, slugs: list[str], k: int, least_weight: float = 0.3, depth: int = 1, tags: list[str] | None = None
) -> DataFrame:
    """Paragraphs of documents within ``depth`` similarity edges of the seeds, best entity overlap first, scored by the last edge.

    The last edge is heavier than ``least_weight``, or shares a tag with the query if edges have tags. similar: src, dst,
    weight and perhaps tags[] (either direction); paragraphs: node_id, document_id, entity_slugs; seeds: document_id (few).
    A document reached several times counts with its heaviest last edge; hops are the fewest.
    """
    strings = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    shared = F.coalesce(F.arrays_overlap("tags", strings(tags)), F.lit(False)) if tags and "tags" in similar.columns else F.lit(False)
    edges = similar.select("src", "dst", "weight", ((F.col("weight") > least_weight) | shared).alias("good"))
    edges = edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))
    seeds = seeds.select("document_id").distinct()
    front, parts = seeds, []
    for hop in range(1, depth + 1):
        step = edges.join(front, F.col("src") == F.col("document_id"), "left_semi")
        parts.append(step.where("good").groupBy(F.col("dst").alias("document_id")).agg(F.max("weight").alias("score")).withColumn("hops", F.lit(hop)))
        front = step.select(F.col("dst").alias("document_id")).distinct()
    reached = reduce(DataFrame.unionByName, parts).groupBy("document_id").agg(F.max("score").alias("score"), F.min("hops").alias("hops"))
    reached = reached.join(seeds, "document_id", "left_anti")
    found = paragraphs.join(reached, "document_id").withColumn("overlap", F.size(F.array_intersect(F.coalesce("entity_slugs", strings([])), strings(slugs))))
    if slugs:
        found = found.where("overlap > 0")
    return found.orderBy(F.desc("overlap"), F.desc("score"), "node_id").limit(k)


def question_classes(questions: DataFrame) -> DataFrame:
    """node_id, class_id, n_others: nodes with the same question (key) are a class, named after the smallest of them.

    A class of n nodes stands for n (n - 1) ANSWERS_SAME edges, which are never written out.
    """
    classes = questions.groupBy("key").agg(F.min("node_id").alias("class_id"), (F.count("*") - 1).alias("n_others"))
    return questions.join(classes, "key").select("node_id", "class_id", "n_others")


def answers_same(classes: DataFrame, seeds: DataFrame, seen: DataFrame, k: int, score: float = 0.7) -> DataFrame:
    """Nodes of the seeds' question classes (node_id, class_id), at a constant score."""
    wanted = classes.join(seeds.select("node_id").distinct(), "node_id", "left_semi").select("class_id").distinct()
    found = classes.join(wanted, "class_id", "left_semi").select("node_id").distinct()
    return top(found.join(seen.select("node_id").unionByName(seeds.select("node_id")).distinct(), "node_id", "left_anti").withColumn("score", F.lit(score)), k)


def community_pivot(mentions: DataFrame, members: DataFrame, slugs: DataFrame, seen: DataFrame, k: int, score: float = 0.35) -> DataFrame:
    """Nodes that mention other members of the slugs' communities, at a constant score. members: slug, label."""
    slugs = slugs.select("slug").distinct()
    labels = members.join(slugs, "slug", "left_semi").select("label").distinct()
    others = members.join(labels, "label", "left_semi").join(slugs, "slug", "left_anti").select("slug")
    found = mentions.join(others, "slug", "left_semi").select("node_id").distinct().join(seen.select("node_id").distinct(), "node_id", "left_anti")
    return top(found.withColumn("score", F.lit(score)), k)


def adamic_pivot(mentions: DataFrame, ties: DataFrame, slugs: DataFrame, seen: DataFrame, k: int, least: float = 0.5, factor: float = 0.4) -> DataFrame:
    """Nodes that mention entities strongly tied to the slugs, by the strongest tie. ties: slug, other, weight."""
    near = ties.where(F.col("weight") >= least).join(slugs.select("slug").distinct(), "slug", "left_semi").groupBy(F.col("other").alias("slug")).agg(F.max("weight").alias("weight"))
    found = mentions.join(near, "slug").groupBy("node_id").agg((F.max("weight") * factor).alias("score"))
    return top(found.join(seen.select("node_id").distinct(), "node_id", "left_anti"), k)


def bm25_batch(counts: DataFrame, total: DataFrame, asked: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """query_id, node_id, score of every node with a word of each of many queries, in one plan.

    counts: node_id, dl, word, tf (a node's words, without stop words); total: one row, n (nodes, those without words too);
    asked: query_id, word. A word is sought once for all queries that have it.
    """
    df = counts.join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    stats = total.crossJoin(counts.agg(F.sum("tf").alias("len")))  # one row
    idf = df.crossJoin(F.broadcast(stats)).select("word", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), (F.col("len") / F.col("n")).alias("avg"))
    norm = config.bm25_k1 * (1 - config.bm25_b + config.bm25_b * F.col("dl") / F.col("avg"))
    scored = counts.join(idf, "word").select("word", "node_id", (F.col("idf") * F.col("tf") * (config.bm25_k1 + 1) / (F.col("tf") + norm)).alias("s"))
    return scored.join(asked.distinct(), "word").groupBy("query_id", "node_id").agg(F.sum("s").alias("score"))


def facets(docs: DataFrame, words: str, haystack: Column, date: Column, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Rows that hold all words somewhere and, if a window is given, a date within it."""
    found = docs
    for word in words.lower().split():
        found = found.where(F.lower(haystack).contains(word))
    if date_from is not None:
        found = found.where(date >= F.lit(date_from))
    if date_to is not None:
        found = found.where(date <= F.lit(date_to))
    return found
