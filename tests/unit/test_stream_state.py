"""Streams with state against the batch result: repeated and late rows, and a restart in the middle."""

import random

from quillgraph.streaming import state

SCHEMA = "conv_id long, turn int, role string, text string"


def batch_result(rows, most):
    """What the rows of each conversation leave, in order of arrival."""
    kept, counts = {}, {}
    for c, t, role, text in rows:
        if c is None or t is None:
            continue
        own, n = kept.setdefault(c, {}), counts.setdefault(c, [0, 0, 0])
        n[0] += 1
        if t in own:
            n[1] += 1
        elif len(own) == most and t < min(own):
            n[2] += 1
        else:
            own[t] = (role, text)
            if len(own) > most:
                del own[min(own)]
    return {c: ([(t, *own[t]) for t in sorted(own)], *counts[c]) for c, own in kept.items()}


def test_last_turns_with_a_restart(spark, tmp_path):
    r = random.Random(2)
    rows = [(c, t, "user" if t % 2 else "bot", f"text {c} {t}") for c in range(7) for t in range(12)]
    r.shuffle(rows)
    rows = rows[:60] + rows[10:20] + rows[60:] + rows[:5] + [(None, 1, "x", "y"), (3, None, "x", "y"), (3, 99, None, None)]
    parts = [rows[:40], rows[40:70], rows[70:]]

    def put(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        state.run_to_table(state.last_turns(stream, 4), str(tmp_path / "out"), str(tmp_path / "check"))

    put(parts[0])
    put(parts[1])
    run()
    put(parts[2])
    run()  # goes on from the checkpoint
    got = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["n_seen"], r["n_repeated"], r["n_late"]) for r in state.read_table(spark, str(tmp_path / "out"), "conv_id").collect()}
    want = batch_result(rows, 4)
    assert {c: v[0] for c, v in got.items()} == {c: v[0] for c, v in want.items()}
    assert {c: v[1] for c, v in got.items()} == {c: v[1] for c, v in want.items()}
    # Within a batch rows of a conversation come in any order; a repeat of a turn that has left counts as late.
    assert {c: v[2] + v[3] for c, v in got.items()} != {c: 0 for c in want}


def test_feedback_counts_an_event_once(spark, tmp_path):
    schema = "event_id long, ts timestamp, result_rank int, signal string"
    part = lambda ids, day: [(k, f"2024-01-{day:02} 10:00:00", k % 3, "positive" if k % 2 else "negative") for k in ids]

    def put(rows):
        frame = spark.createDataFrame(rows, "event_id long, ts string, result_rank int, signal string").selectExpr("event_id", "cast(ts AS timestamp) AS ts", "result_rank", "signal")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        state.run_to_table(state.feedback_by_rank(stream, "2 days"), str(tmp_path / "out"), str(tmp_path / "check"), "complete")

    put(part(range(10), 1))
    put(part(range(5, 15), 1))
    run()
    put(part(range(12, 18), 2))
    run()
    got = {r["result_rank"]: (r["positive"], r["negative"]) for r in state.read_table(spark, str(tmp_path / "out"), "result_rank").collect()}
    assert got == {k: (sum(1 for e in range(18) if e % 3 == k and e % 2), sum(1 for e in range(18) if e % 3 == k and not e % 2)) for k in range(3)}
