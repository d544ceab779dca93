"""The pipeline against a brute-force version, and the guard around its absence."""

import os
import subprocess
import sys

import pytest

import corpus_pipeline
from quillgraph.llm import decontaminate, jaccard_join, langid, mixing, tokenfile

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_equals_brute_force(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(frame)
    kept = [k for k, fits in zip(sorted(docs), langid.known(model, [docs[k]["text"] for k in sorted(docs)]), strict=True) if fits]
    sets = {k: set(jaccard_join._as_set(docs[k]["text"]).tolist()) for k in kept}
    root = {k: k for k in kept}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(kept):
        for b in kept[i + 1 :]:
            if docs[a]["text"] == docs[b]["text"] or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = [k for k in kept if find(k) == k]
    index = decontaminate.build_index(spark.read.parquet(f"{SF}/benchmark.parquet"))
    kept = [k for k in kept if not index.search(docs[k]["text"])]
    left = frame.where(frame["doc_id"].isin(kept))
    kept = sorted(r["doc_id"] for r in mixing.with_probabilities(left).where("mix_selected").collect())
    encoder = tokenfile.WordEncoder(tokenfile.tokenizer_path())
    start, want = 0, []
    for k in kept:
        n = len(encoder.tokenizer.encode(docs[k]["text"], add_special_tokens=False).ids) + 1
        want.append((k, start, n))
        start += n
    got = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and want


def test_stages_keep_the_columns(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, SF).columns == frame.columns


def _tables(spark, folder, docs, items):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, _key int, mix_topic string, lang_pred string"
    spark.createDataFrame([(*d, len(d[1] or ""), "n", 1, "t", "p") for d in docs], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_tables_go_through(spark, tmp_path):
    """Nulls in every column, repeated rows, empty and letterless texts, columns that the stages use themselves."""
    prose = [" ".join(f"word{(7 * k + j * j) % 83}" for j in range(80)) for k in range(12)]
    leak = "this passage stands in the benchmark and should never be found in what a model is trained on"
    docs = [(k, t, ["en", "de", None][k % 3], ["src0", "src1", None][k % 3]) for k, t in enumerate(prose)]
    docs += [(0, prose[0], "en", "src0"), (50, prose[1], "fr", "src2"), (None, prose[2], None, None), (None, None, None, None), (60, None, "en", "src0"), (61, "", "en", "src0"), (62, "12 34", "en", "src0"), (63, leak, "en", "src0")]
    folder = _tables(spark, tmp_path, docs, [(1, leak), (None, None), (2, "")])
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    kept = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == frame.columns
    before_mixing = corpus_pipeline.decontaminate_benchmark(spark, corpus_pipeline.drop_near_duplicates(spark, corpus_pipeline.identify_language(spark, frame, folder), folder), folder)
    assert sorted(r["doc_id"] for r in before_mixing.select("doc_id").collect()) == list(range(12))
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in out} <= set(range(12)) and [r["start"] for r in sorted(out, key=lambda r: r["start"])][:1] in ([], [0])


def test_empty_tables_go_through(spark, tmp_path):
    folder = _tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_entry_without_the_package(tmp_path):
    """The other queries work where the corpus package and the pipeline are absent."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in os.listdir(root):
        if name not in ("corpus_pipeline.py", "quillgraph", ".git", "tests"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "quillgraph")
    for name in os.listdir(f"{root}/quillgraph"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/quillgraph/{name}", tmp_path / "quillgraph" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
