"""Graph operators over edge frames (src, dst, relation, weight): traversal, construction, analytics and upkeep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT, EngineConfig
from quillgraph.operators import setjoin
from quillgraph.state import written


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def traverse(edges: DataFrame, start: DataFrame, depth: int, relations: list[str] | None = None, any_direction: bool = False, prune: bool = False, seen: DataFrame | None = None) -> DataFrame:
    """start, node_id, hops of every path of 1 to depth edges, each edge once in a path.

    A relation filter looks at the last edge only, so a path may pass through any relation; with ``prune`` all its
    edges must match. A vertex that two paths reach comes twice. The loop runs over the few hops of a traversal.
    """
    base = edges.select("src", "dst", "relation").withColumn("eid", F.xxhash64("src", "dst", "relation"))
    if prune and relations:
        base = base.where(F.col("relation").isin(relations))
    if any_direction:
        base = undirected(base)
    front = start.select(F.col("node_id").alias("start"), "node_id").withColumn("path", F.array().cast("array<long>"))
    found = None
    for hop in range(1, depth + 1):
        step = front.join(base, front["node_id"] == base["src"]).where(~F.array_contains("path", F.col("eid")))
        front = step.select("start", F.col("dst").alias("node_id"), F.array_append("path", F.col("eid")).alias("path"), "relation")
        level = front.select("start", "node_id", F.lit(hop).alias("hops"), "relation")
        found = level if found is None else found.unionByName(level)
        front = front.drop("relation")
    if relations:
        found = found.where(F.col("relation").isin(relations))
    if seen is not None:
        found = found.join(seen.select("node_id").distinct(), "node_id", "left_anti")
    return found


def ancestors(hierarchy: DataFrame, depth: int) -> DataFrame:
    """tag, ancestor, distance (fewest hops) over child, parent rows."""
    step = hierarchy.select(F.col("child").alias("tag"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    found = step
    for _ in range(depth - 1):
        step = step.join(hierarchy, F.col("ancestor") == F.col("child")).select("tag", F.col("parent").alias("ancestor"), (F.col("distance") + 1).alias("distance"))
        step = step.groupBy("tag", "ancestor").agg(F.min("distance").alias("distance"))
        found = found.unionByName(step)
    return found.groupBy("tag", "ancestor").agg(F.min("distance").alias("distance"))


def tag_distance(hierarchy: DataFrame, pairs: DataFrame, depth: int = 6) -> DataFrame:
    """a, b, distance: 0 for the same tag, hops to an ancestor, else the least sum over a common one, else -1."""
    up = ancestors(hierarchy, depth)
    own = pairs.select(F.explode(F.array("a", "b")).alias("tag")).distinct()
    up = up.unionByName(own.select("tag", F.col("tag").alias("ancestor"), F.lit(0).alias("distance")))
    left = up.select(F.col("tag").alias("a"), F.col("ancestor").alias("x"), F.col("distance").alias("da"))
    right = up.select(F.col("tag").alias("b"), F.col("ancestor").alias("x"), F.col("distance").alias("db"))
    met = pairs.join(left, "a").join(right, ["b", "x"]).groupBy("a", "b").agg(F.min(F.col("da") + F.col("db")).alias("distance"))
    return pairs.join(met, ["a", "b"], "left").select("a", "b", F.coalesce("distance", F.lit(-1)).alias("distance"))


def next_edges(nodes: DataFrame, parent: list[str], position: str, relation: str) -> DataFrame:
    """Edges from each node to the next one of its parent."""
    order = Window.partitionBy(*parent).orderBy(position)
    rows = nodes.withColumn("src", F.lag("node_id").over(order)).where(F.col("src").isNotNull())
    return rows.select("src", F.col("node_id").alias("dst"), F.lit(relation).alias("relation"))


def adjacent_edges(nodes: DataFrame, parent: list[str], position: str, kind: str = "node_type") -> DataFrame:
    """NEXT_PARA between neighbouring paragraphs of a parent, ADJACENT_TO between a paragraph and a neighbour of another kind."""
    order = Window.partitionBy(*parent).orderBy(position)
    rows = nodes.withColumns({"src": F.lag("node_id").over(order), "_kind": F.lag(kind).over(order)}).where(F.col("src").isNotNull())
    paragraphs = (F.col(kind) == "Paragraph") & (F.col("_kind") == "Paragraph")
    mixed = (F.col(kind) == "Paragraph") != (F.col("_kind") == "Paragraph")
    return rows.where(paragraphs | mixed).select("src", F.col("node_id").alias("dst"), F.when(paragraphs, "NEXT_PARA").otherwise("ADJACENT_TO").alias("relation"))


def belongs_edges(nodes: DataFrame) -> DataFrame:
    """BELONGS_TO from each node to its section, or to its document where it has none."""
    return nodes.select(F.col("node_id").alias("src"), F.coalesce("section_id", "document_id").alias("dst"), F.lit("BELONGS_TO").alias("relation"))


def keep_first(edges: DataFrame, order: str) -> DataFrame:
    """One edge of each (src, dst, relation), the first by ``order``; all columns as they are."""
    first = edges.groupBy("src", "dst", "relation").agg(F.min_by(F.struct(*edges.columns), order).alias("e"))
    return first.select("e.*")


def cross_edges(similar: DataFrame, mentions: DataFrame, paragraphs: DataFrame, titles: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, relation, other, title: what the given documents are tied to, by similarity (either end) or by the
    entities of their paragraphs, with the other end's title. documents: document_id (few); titles: node_id, title."""
    ties = undirected(similar.select("src", "dst")).select(F.col("src").alias("document_id"), F.col("dst").alias("other"), F.lit("SIMILAR_TO").alias("relation"))
    ties = ties.join(documents, "document_id", "left_semi")
    own = paragraphs.join(documents, "document_id", "left_semi").select("document_id", "node_id")
    named = mentions.join(own, "node_id").select("document_id", F.col("slug").alias("other"), F.lit("MENTIONS").alias("relation"))
    return ties.unionByName(named).distinct().join(titles.withColumnRenamed("node_id", "other"), "other", "left").select("document_id", "relation", "other", "title")


def structure_edges(sections: DataFrame) -> DataFrame:
    """HAS_CHILD and NEXT_SIBLING of sections (node_id, document_id, parent_id, doc_position)."""
    up = F.coalesce("parent_id", "document_id")
    child = sections.select(up.alias("src"), F.col("node_id").alias("dst"), F.lit("HAS_CHILD").alias("relation"))
    return child.unionByName(next_edges(sections.withColumn("_up", up), ["document_id", "_up"], "doc_position", "NEXT_SIBLING"))


def co_mentions(mentions: DataFrame) -> DataFrame:
    """RELATED_TO between entities (src < dst) of the same paragraph; a row for each paragraph that has both."""
    rows = written(mentions.where("node_id IS NOT NULL AND slug IS NOT NULL").select("node_id", "slug").distinct(), "mentions")
    own = lambda c: rows.select("node_id", F.col("slug").alias(c))
    met = setjoin.met_on(own("src"), own("dst"), "node_id", rows.groupBy("node_id").agg(F.count("*").alias("d")))
    return met.where("src < dst").select("src", "dst", F.lit("RELATED_TO").alias("relation"))


def set_similarity(members: DataFrame, measure: str = "dice", threshold: float = DEFAULT.similarity_threshold, new: DataFrame | None = None) -> DataFrame:
    """src, dst, shared, dice, jaccard of sets (set_id, item) alike enough; with ``new`` (set_id) only pairs with one of those."""
    return setjoin.similar_sets(members, measure, threshold, new)


#: Neighbours of a node that one block of its pairs takes from each side.
BLOCK_NEIGHBOURS = 1 << 10


def shared_neighbours(edges: DataFrame) -> DataFrame:
    """w, node, d, share: every node under each of its neighbours w, the degree of w, and what w adds to a pair."""
    both = undirected(edges.select("src", "dst")).where("src <> dst").distinct()
    degree = both.groupBy(F.col("dst").alias("w")).agg(F.count("*").alias("d")).withColumn("share", 1.0 / F.log(F.greatest("d", F.lit(2))))
    return both.select(F.col("dst").alias("w"), F.col("src").alias("node")).join(degree, "w").where("d > 1")


def split_heavy(near: DataFrame, config: EngineConfig = DEFAULT, hub: int = BLOCK_NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """The neighbours of each node, parted: of its heaviest ones, which alone can't make a pair, those of more than ``hub`` neighbours; and the others.

    The heaviest ones are too few (below ``aa_least_common``) or add too little (below ``aa_threshold``). A pair that
    counts has a common neighbour among the others of both its nodes: of all common ones, that of lowest degree.
    """
    # A share is above 1 / 30 for any degree that 64 bits count, so the heaviest ones are few.
    most = int(config.aa_threshold * 45) + config.aa_least_common
    order = Window.partitionBy("node").orderBy(F.desc("d"), F.desc("w"))
    first = near.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most)
    sums = first.where(F.col("d") > hub).withColumn("_sum", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    heavy = sums.where((F.col("_sum") < config.aa_threshold - 1e-9) | (F.col("_k") < config.aa_least_common)).select("node", "w", "share")
    heavy = written(heavy, "heavy")  # a few rows a node, none without hubs
    return heavy, near if heavy.isEmpty() else near.join(heavy.select("node", "w"), ["node", "w"], "left_anti")


def wedges(near: DataFrame, block: int = BLOCK_NEIGHBOURS) -> DataFrame:
    """src, dst, share: the pairs (src < dst) of nodes under each w.

    The nodes under a w are dealt by hash into blocks, and each pair of blocks is a key of its own: the pairs of a hub are made
    by as many tasks as it has pairs of blocks.
    """
    blocks = F.ceil(F.col("d") / F.lit(block)).cast("int")
    near = near.withColumns({"_blocks": blocks, "_own": F.pmod(F.xxhash64("node"), blocks).cast("int")})
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    left = near.select("w", "share", F.col("node").alias("_a"), F.col("_own").alias("_i"), other.alias("_j")).where("_i <= _j")
    right = near.select("w", F.col("node").alias("_b"), F.col("_own").alias("_j"), other.alias("_i")).where("_i <= _j")
    pairs = left.join(right, ["w", "_i", "_j"]).where("_i < _j OR _a < _b")
    return pairs.select(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"), "share")


def adamic_adar(edges: DataFrame, config: EngineConfig = DEFAULT, block: int = BLOCK_NEIGHBOURS) -> DataFrame:
    """src, dst, weight, common of node pairs with common neighbours: the sum of 1 / ln(degree) over these.

    Pairs come from neighbours that can make one; what the heaviest neighbours add is looked up for these pairs only, so
    a hub that reaches everything makes no pairs of its own.
    """
    near = written(shared_neighbours(edges), "near")
    good = (F.col("common") >= config.aa_least_common) & (F.col("weight") >= config.aa_threshold)
    summed = lambda pairs: pairs.groupBy("src", "dst").agg(F.sum("share").alias("_s"), F.count("*").alias("_c"))
    if near.where(F.col("d") > block).isEmpty():
        # Every node is one block.
        a, b = near.select("w", F.col("node").alias("src"), "share"), near.select("w", F.col("node").alias("dst"))
        pairs = summed(setjoin.met_on(a, b, "w", near.select("w", "d").distinct()).where("src < dst"))
        return pairs.select("src", "dst", F.col("_s").alias("weight"), F.col("_c").alias("common")).where(good)
    heavy, light = split_heavy(near, config, block)
    light = light.select("node", "w", "d", "share")
    pairs = written(summed(wedges(light, block)), "pairs")
    own = lambda rows, c, *more: rows.select(F.col("node").alias(c), "w", *more)
    both = pairs.select("src", "dst")
    # Heavy for the first node, of any kind for the second; and heavy for the second node only.
    added = both.join(own(heavy, "src", "share"), "src").join(own(near, "dst"), ["dst", "w"])
    added = added.unionByName(both.join(own(heavy, "dst", "share"), "dst").join(own(light, "src"), ["src", "w"]))
    total = pairs.unionByName(added.groupBy("src", "dst").agg(F.sum("share").alias("_s"), F.count("*").alias("_c")))
    total = total.groupBy("src", "dst").agg(F.sum("_s").alias("weight"), F.sum("_c").alias("common"))
    return total.where(good)


def precedes(edges: DataFrame, dates: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """PRECEDES from the earlier to the later document of each edge; equal or missing dates give none.

    dates: node_id, published.
    """
    d = lambda c: dates.select(F.col("node_id").alias(c), F.col("published").alias(f"{c}_date"))
    rows = edges.select("src", "dst").join(d("src"), "src").join(d("dst"), "dst").where("src_date <> dst_date")
    early = F.col("src_date") < F.col("dst_date")
    rows = rows.select(F.when(early, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(early, F.col("dst")).otherwise(F.col("src")).alias("dst")).distinct()
    return rows if existing is None else rows.join(existing.select("src", "dst"), ["src", "dst"], "left_anti")


def isolation(nodes: DataFrame, edges: DataFrame, least: int = DEFAULT.isolation_degree) -> DataFrame:
    """node_id, degree (edge rows, either end), isolated."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    rows = nodes.select("node_id").join(ends, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return rows.withColumn("isolated", F.col("degree") < least)


def evergreen(edges: DataFrame, nodes: DataFrame, least: int = DEFAULT.evergreen_indegree) -> DataFrame:
    """node_id, indegree, decay_class: often-cited documents become EVERGREEN."""
    into = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("indegree"))
    rows = nodes.join(into, "node_id", "left").withColumn("indegree", F.coalesce("indegree", F.lit(0)))
    return rows.withColumn("decay_class", F.when(F.col("indegree") >= least, "EVERGREEN").otherwise(F.col("decay_class")))


def voter_lists(edges: DataFrame, turn: Column) -> DataFrame:
    """node_id, turn, voters: the different neighbours of each node that vote in a turn, at most BLOCK_NEIGHBOURS in a row.

    Both directions come from one reading of the edges, which move once. turn: over node_id.
    """
    end = lambda a, b: F.struct(F.col(a).alias("node_id"), F.col(b).alias("other"))
    both = edges.where("src <> dst").select(F.explode(F.array(end("src", "dst"), end("dst", "src"))).alias("e")).select(F.col("e.other").alias("voter"), "e.node_id")
    pairs = both.repartition(4 * edges.sparkSession.sparkContext.defaultParallelism, "node_id").distinct()
    pairs = pairs.withColumnsRenamed({"node_id": "to", "voter": "node_id"}).select("to", turn.cast("int").alias("turn"), "node_id")
    kind = dict(pairs.dtypes)["to"]
    return pairs.mapInArrow(_lists, f"node_id {kind}, turn int, voters array<{kind}>")


def _lists(batches: Iterator[pa.RecordBatch], most: int = BLOCK_NEIGHBOURS, chunk: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The third column listed by the first two, of some rows at a time: several lists of a node are as good as one."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= chunk:
            yield from _listed(held, most)
            held, n = [], 0
    yield from _listed(held, most)


def _listed(batches: list[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches).combine_chunks() if batches else []
    if not len(rows):
        return
    node, turn = pc.dictionary_encode(rows.column(0).chunk(0)).indices.to_numpy(), rows.column(1).to_numpy()
    order = np.lexsort((turn, node))
    new = np.r_[True, (np.diff(node[order]) != 0) | (np.diff(turn[order]) != 0)]
    at = np.arange(len(order))
    starts = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % most == 0)
    rows = rows.take(pa.array(order)).combine_chunks().to_batches()[0]
    lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(order)], pa.int32()), rows.column(2))
    first = rows.take(pa.array(starts))
    found = pa.RecordBatch.from_arrays([first.column(0), first.column(1), lists], names=["node_id", "turn", "voters"])
    yield from (found.slice(low, 1 << 14) for low in range(0, len(found), 1 << 14))


def label_propagation(edges: DataFrame, sweeps: int = 30, turn: Column | None = None) -> DataFrame:
    """node_id, label after at most so many sweeps: the most frequent label of the neighbours, ties to the smaller one.

    A sweep has two halves, in which the nodes of turn 0 and then those of turn 1 vote (by a hash unless given), so that
    two sides of a graph can't swap labels for ever. It ends once a sweep changes nothing. Labels lie in the shared
    folder between halves. A node without neighbours isn't in the edges and has no label. In a half each node sends its label
    to the lists of those that vote; an edge is a row only from there to the count.
    """
    turn = F.pmod(F.xxhash64("node_id"), F.lit(2)) if turn is None else turn
    near = written(voter_lists(edges, turn), "near")
    labels = near.select("node_id").distinct().select("node_id", F.col("node_id").alias("label"), turn.cast("int").alias("turn"), F.lit(False).alias("moved"))
    labels, still = written(labels, "labels"), 0
    for half in range(2 * sweeps):
        # Only the half that may move is counted.
        sent = near.where(F.col("turn") == half % 2).join(labels.select("node_id", "label"), "node_id")
        votes = sent.select(F.explode("voters").alias("src"), "label").groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("src").alias("node_id")).agg(F.min(F.struct((-F.col("n")).alias("m"), "label"))["label"].alias("best"))
        now = F.coalesce("best", "label")
        labels = written(labels.join(best, "node_id", "left").select("node_id", now.alias("label"), "turn", (now != F.col("label")).alias("moved")), "labels")
        still = still + 1 if labels.where("moved").isEmpty() else 0
        if still == 2:
            break
    return labels.select("node_id", "label")


def communities(labels: DataFrame, least_size: int = 2, most_members: int = 30) -> DataFrame:
    """label, member_count and its first members, of communities large enough."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("member_count")).where(F.col("member_count") >= least_size)
    # Each task keeps its first members only, so a community of any size meets as a few rows.
    ranked = labels.withColumn("_k", F.row_number().over(Window.partitionBy("label").orderBy("node_id"))).where(F.col("_k") <= most_members)
    first = ranked.groupBy("label").agg(F.sort_array(F.collect_list("node_id")).alias("members"))
    return sizes.join(first, "label").select("label", "member_count", "members")


def surprising(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds is_surprising: the two ends are in different communities; ends without one are never surprising."""
    c = lambda end: labels.select(F.col("node_id").alias(end), F.col("label").alias(f"_{end}"))
    rows = edges.join(c("src"), "src", "left").join(c("dst"), "dst", "left")
    return rows.withColumn("is_surprising", F.coalesce(F.col("_src") != F.col("_dst"), F.lit(False))).drop("_src", "_dst")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("node_id").distinct()
    ok = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return edges.join(ok.select("src", "dst", "relation").distinct(), ["src", "dst", "relation"], "left_anti")


def touching(edges: DataFrame, strays: DataFrame) -> DataFrame:
    """Edges with an end among some ids (node_id) that are no nodes, or without an end; each once."""
    end = lambda c: strays.select(F.col("node_id").alias(c))
    key = edges.withColumns({"src": F.col("src").cast("string"), "dst": F.col("dst").cast("string")})
    other = key.join(end("src"), "src", "left_anti").where("src IS NOT NULL")
    found = [key.where("src IS NULL"), key.join(end("src"), "src", "left_semi"), other.where("dst IS NULL"), other.join(end("dst"), "dst", "left_semi")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("node_id").distinct()
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def cascade_delete(nodes: DataFrame, edges: DataFrame, document_id) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without a document, all that belongs to it, and every edge that touches those."""
    gone = nodes.where(F.coalesce(F.col("document_id") == F.lit(document_id), F.lit(False)) | (F.col("node_id") == F.lit(document_id))).select("node_id")
    left = edges
    for end in ("src", "dst"):
        left = left.join(gone.withColumnRenamed("node_id", end), end, "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), left.select(*edges.columns)


def without_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that some edge touches."""
    return nodes.join(edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct(), "node_id", "left_semi")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst", "relation").agg(F.count("*").alias("n")).where("n > 1")


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch the given nodes, from their side: node_id, other, relation, outgoing; an OR join as two equi joins."""
    ids = ids.select("node_id").distinct()
    out = edges.join(ids, edges["src"] == ids["node_id"]).select("node_id", F.col("dst").alias("other"), "relation", F.lit(True).alias("outgoing"))
    into = edges.join(ids, edges["dst"] == ids["node_id"]).select("node_id", F.col("src").alias("other"), "relation", F.lit(False).alias("outgoing"))
    return out.unionByName(into)
