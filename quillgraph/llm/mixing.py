"""Mixing sources to target weights by iterative proportional fitting (raking), with DataFrame functions only.

Tokens are summed once per cell (source category x language category x topic category). The cells are as many as the
stated targets allow, whatever the corpus: a value without a target of its own falls into the category ``*``. The
cells are raked in turn to each margin, and each round ends with a trim of the weight ratio to [1/cap, cap], so that no
document needs a probability above 1. A document's probability is its cell's ratio / cap; it is selected if a hash of
seed and doc_id, read as a number in [0, 1), falls below it.

The trim comes last, so a margin that needs a ratio beyond the cap is missed; ``attained`` reports every margin beside
its target. With ``cap=None`` the cells are raked until all margins hold, and probabilities are ratios over the greatest
ratio found: the margins are met, at the price of a much smaller sample. If they can't hold together, that is an error.

Defined cases: a null text has 0 tokens; null source or language: category ``*``; a cell without tokens gets ratio 1;
targets of absent categories are shared out in proportion; repeated rows are separate documents with the same draw; a
null doc_id draws as an empty string; an empty table gives an empty result; further columns are kept by
``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import table

#: Rounds of raking; each goes over every margin.
ROUNDS = 10
#: A document's weight lies between 1/CAP and CAP times the even one.
CAP = 4.0
SEED = "mix-1"
#: Raking without a cap ends when no share is off by more than TOLERANCE, and fails after MOST_ROUNDS.
TOLERANCE = 1e-9
MOST_ROUNDS = 1000

SOURCE_TARGETS = {"src0": 0.2, **{f"src{k}": 0.75 / 19 for k in range(1, 20)}, "*": 0.05}
LANG_TARGETS = {"en": 0.5, "de": 0.16, "fr": 0.16, "es": 0.16, "*": 0.02}
#: Rare topics are raised to two or three times their share of a prose corpus, which the cap allows.
TOPIC_TARGETS = {"legal": 0.03, "contact": 0.03, "numeric": 0.006, "listing": 0.006, "note": 0.008, "article": 0.46, "book": 0.46}

#: Words of a text: its white space plus one, as SQL that Spark and DuckDB share.
TOKENS_SQL = "CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(translate(text, ' \n\t', '')) + 1 END"
#: A coarse topic by form, the first that applies.
TOPIC_SQL = """CASE WHEN text LIKE '%icense%' THEN 'legal' WHEN text LIKE '%@%' THEN 'contact'
 WHEN length(text) - length(translate(text, '0123456789', '')) > 0.02 * length(text) THEN 'numeric'
 WHEN (length(text) - length(replace(text, '\n', ''))) * 100 > length(text) THEN 'listing'
 WHEN coalesce(length(text), 0) < 400 THEN 'note' WHEN length(text) < 4000 THEN 'article' ELSE 'book' END"""


def _lookup(targets: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])


def _category(value: Column, targets: dict[str, float]) -> Column:
    return F.when(value.isin(list(targets)), value).otherwise(F.lit("*"))


def rake(cells: DataFrame, margins: dict[str, dict[str, float]], rounds: int = ROUNDS, cap: float = CAP) -> DataFrame:
    """Adds ``ratio`` (target weight over corpus weight) to cells of category columns and ``tokens``.

    The cells are a bounded number, so they stay in one partition and no round shuffles.
    """
    everything = Window.partitionBy()
    cells = cells.withColumn("share", F.col("tokens") / F.sum("tokens").over(everything)).withColumn("w", F.col("share"))
    for _ in range(rounds):
        for name, targets in margins.items():
            total = F.sum("w").over(Window.partitionBy(name))
            target = F.element_at(_lookup(targets), F.col(name))
            cells = cells.withColumn("w", F.when(total > 0, F.col("w") * target / total).otherwise(F.lit(0.0)))
        cells = cells.withColumn("w", F.greatest(F.least(F.col("w") / F.sum("w").over(everything), F.col("share") * cap), F.col("share") / cap))
    ratio = F.col("w") / F.col("share")
    return cells.withColumn("ratio", F.when(F.col("share") > 0, ratio).otherwise(F.lit(1.0)))


def _present(cells: list, margin: str, targets: dict[str, float]) -> dict[str, float]:
    """Targets of the categories that have tokens, shared out to 1."""
    there = {c[margin] for c in cells if c["tokens"]}
    total = sum(v for k, v in targets.items() if k in there)
    return {k: v / total for k, v in targets.items() if k in there} if total else {}


def rake_fully(cells: DataFrame, margins: dict[str, dict[str, float]]) -> tuple[DataFrame, float]:
    """Cells with the ``ratio`` at which all margins hold, and the greatest ratio.

    The cells are a bounded number, so the driver rakes them; how many rounds that takes isn't known before.
    """
    keys = list(margins)
    rows = sorted(cells.collect(), key=lambda r: [r[k] for k in keys])
    everything = sum(r["tokens"] for r in rows)
    share = [r["tokens"] / everything if everything else 0.0 for r in rows]
    w, targets = list(share), {k: _present(rows, k, t) for k, t in margins.items()}

    def sums(margin):
        out = dict.fromkeys(targets[margin], 0.0)
        for r, x in zip(rows, w, strict=True):
            if x:
                out[r[margin]] += x
        return out

    for _ in range(MOST_ROUNDS):
        for k in keys:
            have = sums(k)
            w = [x * targets[k][r[k]] / have[r[k]] if x else 0.0 for r, x in zip(rows, w, strict=True)]
        miss = max((abs(v - targets[k][c]) for k in keys for c, v in sums(k).items()), default=0.0)
        if miss <= TOLERANCE:
            break
    else:
        raise ValueError(f"the margins can't hold together: a share is off by {miss:.4f} after {MOST_ROUNDS} rounds")
    ratio = [x / s if s else 1.0 for x, s in zip(w, share, strict=True)]
    schema = ", ".join(f"{k} string" for k in keys) + ", ratio double"
    greatest = max((x for x, s in zip(ratio, share, strict=True) if s), default=1.0)
    return cells.sparkSession.createDataFrame([(*(r[k] for k in keys), x) for r, x in zip(rows, ratio, strict=True)], schema), greatest


def with_probabilities(
    docs: DataFrame,
    source_targets: dict[str, float] = SOURCE_TARGETS,
    lang_targets: dict[str, float] = LANG_TARGETS,
    topic_targets: dict[str, float] = TOPIC_TARGETS,
    cap: float | None = CAP,
    seed: str = SEED,
) -> DataFrame:
    """Adds mix_topic, mix_tokens, mix_weight, mix_probability and mix_selected to each document."""
    tagged = docs.withColumns(
        {
            "mix_tokens": F.expr(TOKENS_SQL).cast("long"),
            "mix_topic": F.expr(TOPIC_SQL),
            "mix_s": _category(F.col("source"), source_targets),
            "mix_l": _category(F.col("lang"), lang_targets),
        }
    )
    keys = ["mix_s", "mix_l", "mix_topic"]
    cells = tagged.groupBy(*keys).agg(F.sum("mix_tokens").cast("double").alias("tokens")).coalesce(1)
    margins = {"mix_s": source_targets, "mix_l": lang_targets, "mix_topic": topic_targets}
    raked, cap = rake_fully(cells, margins) if cap is None else (rake(cells, margins, cap=cap), cap)
    # As many rows as the targets have combinations: a proven bound, so the broadcast never grows with the corpus.
    raked = F.broadcast(raked.select(*keys, F.round("ratio", 6).alias("mix_weight")))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10)
    return (
        tagged.join(raked, keys)
        .withColumn("mix_probability", F.round(F.col("mix_weight") / cap, 8))
        .withColumn("mix_selected", draw.cast("double") / F.lit(4294967296.0) < F.col("mix_probability"))
        .drop("mix_s", "mix_l")
    )


def attained(
    mixed: DataFrame,
    source_targets: dict[str, float] = SOURCE_TARGETS,
    lang_targets: dict[str, float] = LANG_TARGETS,
    topic_targets: dict[str, float] = TOPIC_TARGETS,
) -> DataFrame:
    """margin, category, target, corpus (share of its tokens) and attained (share of the expected sample) of what with_probabilities gave."""
    margins = {"source": (source_targets, _category(F.col("source"), source_targets)), "lang": (lang_targets, _category(F.col("lang"), lang_targets)), "topic": (topic_targets, F.col("mix_topic"))}
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), c.alias("category")) for m, (_, c) in margins.items()]))
    expected = F.sum(F.col("mix_tokens") * F.col("mix_probability"))
    sums = mixed.select("mix_tokens", "mix_probability", pairs.alias("p")).groupBy("p.margin", "p.category").agg(F.sum("mix_tokens").alias("tokens"), expected.alias("expected"))
    rows = [(m, k, float(v)) for m, (targets, _) in margins.items() for k, v in targets.items()]
    out = mixed.sparkSession.createDataFrame(rows, "margin string, category string, target double").join(sums, ["margin", "category"], "left")
    part = lambda c: F.coalesce(F.col(c) / F.sum(c).over(Window.partitionBy("margin")), F.lit(0.0))
    return out.select("margin", "category", "target", part("tokens").alias("corpus"), part("expected").alias("attained"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents, with their own columns only (whatever those are called)."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "source", "lang")
    return with_probabilities(packed, **options).where("mix_selected").select("_row.*")


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    out = with_probabilities(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"),
        F.col("mix_weight").alias("weight"), F.col("mix_probability").alias("probability"), F.col("mix_selected").alias("selected"),
    )


def _oracle() -> str:
    values = lambda targets: ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in targets.items())
    category = lambda c, t: f"CASE WHEN {c} IN ({', '.join(repr(k) for k in t)}) THEN {c} ELSE '*' END"
    sql = f"""WITH ts(s, tgt) AS (VALUES {values(SOURCE_TARGETS)}), tl(l, tgt) AS (VALUES {values(LANG_TARGETS)}),
tt(t, tgt) AS (VALUES {values(TOPIC_TARGETS)}),
d AS (SELECT *, {TOKENS_SQL} AS n_tokens, {TOPIC_SQL} AS t, {category("source", SOURCE_TARGETS)} AS s, {category("lang", LANG_TARGETS)} AS l FROM documents),
c AS (SELECT s, l, t, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
c0 AS (SELECT *, tokens / sum(tokens) OVER () AS share, tokens / sum(tokens) OVER () AS w FROM c)"""
    at = "c0"
    for k in range(ROUNDS):
        for margin, targets in (("s", "ts"), ("l", "tl"), ("t", "tt")):
            to = f"c{k}{margin}"
            sql += f",\n{to} AS (SELECT a.* REPLACE (CASE WHEN sum(w) OVER (PARTITION BY a.{margin}) > 0 THEN w * tgt / sum(w) OVER (PARTITION BY a.{margin}) ELSE 0 END AS w) FROM {at} a JOIN {targets} b ON a.{margin} = b.{margin})"
            at = to
        sql += f",\nr{k} AS (SELECT * REPLACE (greatest(least(w / sum(w) OVER (), share * {CAP}), share / {CAP}) AS w) FROM {at})"
        at = f"r{k}"
    return sql + f""",
g AS (SELECT s, l, t, round(CASE WHEN share > 0 THEN w / share ELSE 1.0 END, 6) AS weight FROM {at})
SELECT doc_id, source, lang, d.t AS topic, n_tokens::BIGINT AS n_tokens, weight, round(weight / {CAP}, 8) AS probability,
 ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < round(weight / {CAP}, 8) AS selected
FROM d JOIN g ON d.s = g.s AND d.l = g.l AND d.t = g.t"""


OP3_SQL = _oracle()
