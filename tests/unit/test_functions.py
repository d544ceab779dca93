"""Worked examples, computed by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import temporal as TT
from quillgraph.functions import text as T
from quillgraph.functions import vector as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, words", [("Show me the Proof-of-Work in 2008", ["proof", "work", "2008"]), ("", []), ("the of", [])])
def test_tokens(spark, text, words):
    assert one(spark, T.tokens(F.lit(text))) == words


@pytest.mark.parametrize("n, kind", [(3, "keyword"), (4, "phrase"), (31, "paragraph")])
def test_input_type(spark, n, kind):
    assert one(spark, T.input_type(F.array(*[F.lit("word")] * n))) == kind


@pytest.mark.parametrize(
    "text, intent, low, high",
    [
        ("latest bitcoin", "current_state", None, None),
        ("proof work 1994", "historical_fact", "1992", "1996"),
        ("bitcoin", "none", None, None),
        ("proof work 2008", "none", None, None),
        ("bitcoin before 2008", "none", None, "2008"),
        ("bitcoin 1990s", "none", "1990", "1999"),
        ("bitcoin 1994", "historical_fact", "1992", "1996"),
    ],
)
def test_intent_and_range(spark, text, intent, low, high):
    assert one(spark, T.temporal_intent(F.lit(text))) == intent
    found = one(spark, T.date_range(F.lit(text)))
    assert (found["from"], found["to"]) == (low, high)


@pytest.mark.parametrize("text, mode", [("compare X and Y", "synthesis"), ("tell me more about X", "exploratory"), ("what is X", "factoid")])
def test_mode(spark, text, mode):
    assert one(spark, T.query_mode(F.lit(text))) == mode


@pytest.mark.parametrize("text, date", [("1995", "1995"), ("1995-03", "1995-03-01"), ("1995-03-02", "1995-03-02"), ("03/1995", None)])
def test_normal_date(spark, text, date):
    assert one(spark, T.normal_date(F.lit(text))) == date


def test_names(spark):
    assert one(spark, T.slug(F.lit("Bitcoin Network"))) == "bitcoin-network"
    assert one(spark, T.norm_key(F.lit("Bitcoin Network"))) == "bitcoinnetwork"
    assert one(spark, T.repair_name(F.lit("0-05-bitcoin"))) == "0.05 Bitcoin"
    assert one(spark, T.repair_name(F.lit("alice-s-cafe"))) == "Alice's Cafe"
    assert one(spark, T.is_opaque(F.lit("d41d8cd98f00b204e9800998ecf8427e"))) is True
    assert one(spark, T.is_opaque(F.lit("internationalization"))) is False
    assert one(spark, T.is_opaque(F.lit(None).cast("string"))) is False


@pytest.mark.parametrize("text, noise", [("-----", True), ("[...more...]", True), ("ab", True), ("Received: 2001", True), ("A real sentence of prose.", False), (None, False)])
def test_artifacts(spark, text, noise):
    assert one(spark, T.is_artifact(F.lit(text).cast("string"))) is noise


def test_html(spark):
    html = "<html><title>t</title><nav>x</nav><h2 class='a'>A <b>b</b></h2><ul><li>one</li></ul><p>x &amp; y</p></html>"
    assert one(spark, T.html_title(F.lit(html))).asDict() == {"text": "A b", "level": 2}
    assert one(spark, T.html_title(F.lit("<title> T </title>")))["text"] == "T"
    assert one(spark, T.html_title(F.lit("nothing"))) is None
    assert one(spark, T.html_markdown(F.lit(html))) == "t\n## A b\n- one\n\nx & y"
    assert one(spark, T.html_markdown(F.lit("<h1>two\n  lines</h1><p>&#65;&#8364; &amp;copy; &copy;x &lt;b&gt; a &</p>"))) == "# two lines\n\nA\u20ac &copy; x <b> a &"
    assert one(spark, T.html_markdown(F.lit("<script>a</script><header><h1>gone</h1></header><div>x<br/>y</div>"))) == "x\ny"


@pytest.mark.parametrize("text, k", [('{"k": 1}', 1), ('```json\n{"k": 2,}\n```', 2), ('so: {"k": 3} done', 3), ("nothing", None), (None, None)])
def test_repaired_json(spark, text, k):
    found = one(spark, T.repaired_json(F.lit(text).cast("string"), "k int"))
    assert (found and found["k"]) == k


def date(text):
    return F.to_date(F.lit(text))


def test_temporal_score(spark):
    now, false, none = date("2025-01-31"), F.lit(False), F.lit(0.0)
    score = lambda intent, klass, day, raw=0.0, principal=false, cover=none: one(spark, TT.temporal_score(F.lit(intent), principal, F.lit(raw), F.lit(klass), date(day), cover, now))
    assert score("current_state", "CURRENT", "2025-01-01") == pytest.approx(0.148164, abs=1e-6)
    assert score("historical_fact", "CURRENT", "2015-02-03") == pytest.approx(0.126429, abs=1e-4)
    assert score("none", "CURRENT", "2025-01-01") == 0
    assert score("current_state", "CURRENT", "2025-01-01", raw=20.0) == 0
    assert score("current_state", "CURRENT", "2025-01-01", principal=F.lit(True)) == 0
    assert score("current_state", "CURRENT", None) == 0
    assert score("current_state", "CURRENT", "2026-01-01") == 0
    assert score("historical_fact", "SCHOLARLY", "1995-01-01") > score("historical_fact", "SCHOLARLY", "2024-01-01")


def test_coverage(spark):
    null = F.lit(None).cast("date")
    share = one(spark, TT.coverage(date("1995-01-01"), date("2005-01-01"), null, date("1990-01-01"), date("1999-01-01")))
    assert share == pytest.approx(1461 / 3287, abs=1e-9)
    assert one(spark, TT.coverage(null, null, date("1995-01-01"), date("1990-01-01"), date("1999-01-01"))) == 0
    assert one(spark, TT.coverage(null, null, null, date("1990-01-01"), null)) == 0


def test_cosine(spark):
    assert one(spark, V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(2**-0.5)
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert datetime.date(1995, 1, 1) == one(spark, T.parsed_date(F.lit("1995")))


@pytest.mark.parametrize(
    "published, start, end, lenient, strict",
    [
        ("1980-01-01", None, None, False, False),
        ("2005-01-01", None, None, True, True),
        (None, None, None, True, False),
        (None, "1990-01-01", "2001-01-01", True, True),
        ("1980-01-01", "1990-01-01", "2001-01-01", True, True),
        (None, "2011-01-01", "2020-01-01", False, False),
    ],
)
def test_windows(spark, published, start, end, lenient, strict):
    dates = [F.lit(x).cast("string") for x in (published, start, end)]
    assert one(spark, TT.in_window(*dates, "2000", "2010", False)) is lenient
    assert one(spark, TT.in_window(*dates, "2000", "2010", True)) is strict
    assert one(spark, TT.in_window(*dates, None, None)) is True


@pytest.mark.parametrize(
    "html, text",
    [("&#55357;", "�"), ("&#120900;", chr(120900)), ("&#128512;x", "\U0001f600x"), ("&#x27;&#X1F600;", "'\U0001f600"), ("&#0;&#1114112;&#9999999;", "�" * 3), ("&#12345678;", "&#12345678;"), ("&#xg;", "&#xg;")],
)
def test_numbered_entities(spark, html, text):
    assert one(spark, T.html_markdown(F.lit(html))) == text


def test_every_numbered_entity(spark):
    """All numbers in steps, surrogates and those above 65535 included."""
    rows = spark.range(0, 0x110400, 97).select("id", T.decoded(F.format_string("&#%d;", "id")).alias("d"), T.decoded(F.format_string("&#x%x;", "id")).alias("x"))
    for r in rows.collect():
        c = r["id"]
        want = chr(c) if 0 < c < 0x110000 and not 0xD800 <= c < 0xE000 else "�"
        assert r["d"] == r["x"] == want
