"""The four calls of a client: ingest, query, answer, graph context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph import engine
from quillgraph.config import DEFAULT, EngineConfig
from quillgraph.operators import answer as A
from quillgraph.operators import docproc, graph, ingest, mutate
from quillgraph.providers import FirstSentence


def ingest_documents(files: DataFrame, stored: DataFrame, cache: DataFrame, provider, force: bool = False) -> dict[str, DataFrame]:
    """chunks, nodes, metadata and cache entries of the files that are new; files: doc_id, text, file_hash."""
    new = mutate.new_files(files, stored, force)
    chunks = docproc.chunk_markdown(new, "doc_id", "text").select("key", "chunk", "text").withColumnRenamed("key", "document_id")
    nodes, entries = ingest.structured_chunks(chunks, cache, provider)
    return {"chunks": chunks, "nodes": nodes, "metadata": ingest.document_metadata(new), "cache": entries}


def query(spark: SparkSession, stored: engine.Graph, text: str, as_of: str, config: EngineConfig = DEFAULT, **hints) -> dict[str, DataFrame]:
    return engine.run(stored, engine.understand(spark, text, **hints), as_of, config)


def answer(spark: SparkSession, stored: engine.Graph, text: str, as_of: str, provider=None, config: EngineConfig = DEFAULT, **hints) -> dict[str, DataFrame]:
    """A query's tiers, the numbered sources, and a provider's text with citations of them."""
    found = query(spark, stored, text, as_of, config, **hints)
    texts = stored.paragraphs.select("node_id", "content")
    with_text = lambda name: found[name].select("node_id", "score").join(texts, "node_id")
    sources = A.answer_sources(with_text("principal"), with_text("results"))
    return found | {"sources": sources, "answer": A.synthesised(sources, text, provider or FirstSentence())}


def graph_context(stored: engine.Graph, ids: DataFrame, depth: int = 2) -> DataFrame:
    """start, node_id, hops, relation of all that lies within so many edges of nodes, in their direction."""
    return graph.traverse(stored.edges, ids, depth)
