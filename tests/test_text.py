import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.functions import text as tx
from tidemark.operators import documents, search, vectors
from tidemark.operators.documents import ArticleLayout, Selector


def plain_chunks(text, size):
    """Restatement in plain Python: pack sentences, repeat the last one."""
    result, current, used = [], [], 0
    for s in re.split(r"(?<=[.!?])\s+", text):
        if current and used + len(s) > size:
            result.append(" ".join(current))
            used = len(current[-1]) + len(s) + 1
            current = [current[-1], s]
        else:
            current.append(s)
            used += len(s) + 1
    result.append(" ".join(current))
    return result


def test_chunks_match_restatement(spark):
    rng = random.Random(3)
    texts = ["", "one", "No end", "A. B! C?  D.\nE", "x" * 400 + ". y"]
    for _ in range(150):
        words = ["".join(rng.choices("abcdé", k=rng.randint(1, 9))) + rng.choice(["", "", ".", "!", "?\n"]) for _ in range(rng.randint(1, 220))]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for size in (30, 100, 3076):
        got = {r["i"]: r["c"] for r in df.select("i", tx.chunks(F.col("text"), size).alias("c")).collect()}
        for i, text in enumerate(texts):
            assert got[i] == plain_chunks(text, size), (size, text)


def test_chunk_table_skips_blank_texts(spark):
    rows = [("u1", "t", "2024-01-01 00:00:10", "A first. A second."), ("u2", "t", "2024-01-01 00:00:00", "  \n"), ("u3", "t", "2024-01-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "url string, title string, pub_date string, text string").withColumn("pub_date", F.col("pub_date").cast("timestamp_ntz"))
    got = documents.chunk_table(df, size=9).orderBy("chunk_index").collect()
    assert [(r["url"], r["chunk_index"], r["total_chunks"], r["pub_date"], r["chunk"]) for r in got] == [
        ("u1", 0, 2, 1704067210, "A first."),
        ("u1", 1, 2, 1704067210, "A first. A second."),
    ]
    assert got[0]["chunk_identifier"] == "u1#chunk0"


def test_escape_marks_every_reserved_character(spark):
    text = "a" + tx.RESERVED_CHARACTERS + "b_c,d"
    got = spark.range(1).select(tx.escape_search(F.lit(text))).first()[0]
    assert got == "a" + "".join("\\" + c for c in tx.RESERVED_CHARACTERS) + "b_c,d"


def test_words_are_whole_tokens(spark):
    df = spark.createDataFrame([(1, "The bank's rate-cut"), (2, "Thebank rate cut"), (3, None)], "i int, t string")
    words = tx.query_words("RATE, bank!")
    assert words == ["rate", "bank"]
    assert [r["i"] for r in df.where(tx.has_all_words(F.col("t"), words)).collect()] == [1]
    assert df.where(tx.has_all_words(F.col("t"), [])).count() == 0


def test_search_order_and_channel(spark):
    rows = [
        ("u1", "rate cut", "a", "2024-01-01", "vn", "x"),
        ("u2", "other", "a", "2024-01-03", "vn", "a rate cut"),
        ("u3", "rate cut", "a", "2024-01-02", "en", "rate cut again"),
        ("u4", "rate", "a", "2024-01-05", "vn", "cut"),
        ("u5", "rate cut", "a", "2025-01-05", "vn", "late"),
    ]
    df = spark.createDataFrame(rows, "url string, title string, source string, pub_date string, channel_name string, text string")
    df = df.withColumn("pub_date", F.col("pub_date").cast("timestamp_ntz"))
    got = search.search_news(df, "cut rate", "2024-01-01", "2025-12-31", limit=9, as_of="2024-12-31").collect()
    assert [(r["url"], r["score"]) for r in got] == [("u3", 3), ("u1", 2), ("u2", 1), ("u4", 0)]
    assert [r["url"] for r in search.search_news(df, "cut rate", "2024-01-01", "2024-12-31", channel="en").collect()] == ["u3"]


PAGE = """<html><head><title>no</title><script>var a = "<p>no</p>";</script></head><body>
<h1 class="title big"> A <b>bold</b> title </h1><h1 class="title">second</h1>
<div class="sharemxh"><span class="x">no</span><span class="pdate"> 24-07-2024 - 15:20 PM </span></div>
<div class="contentdetail"><p>First <a href="/x">link</a> end.</p><!-- no --><div><p>Sec&amp;ond</p></div><p></p></div>
<p>outside</p></body></html>"""


def read_article(spark, html, layout=ArticleLayout()):
    row = documents.extract_articles(spark.createDataFrame([(1, html)], "k int, html string"), "k", layout=layout).first()
    return row["title"], row["pub_date"] and row["pub_date"].isoformat(), row["text"]


def test_article_parts(spark):
    assert read_article(spark, PAGE) == ("Aboldtitle", "2024-07-24T15:20:00", "Firstlinkend.\nSec&ond")
    assert read_article(spark, "") == read_article(spark, None) == ("", None, "")


def test_unclosed_paragraph_holds_the_next(spark):
    layout = ArticleLayout(title=Selector("h1"), content=Selector("article"))
    html = "<article><h1>T</h1><p>a<br><p>b</p><p>c</article><p>d</p>"
    assert read_article(spark, html, layout) == ("T", None, "abc\nb\nc")


def test_nested_boxes_and_references(spark):
    html = (
        '<div class="contentdetail"><div>x</div><P class="k">a &#233;&#x1F600;&lt;b&gt;</P><div><p>in</p></div></p>'
        "<p>b &amp;lt; &nbsp;</p></div><div><p>out</p></div>"
    )
    assert read_article(spark, html)[2] == "a \u00e9\U0001f600<b>\nin\nb &lt;"


def test_article_rows(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>nothing</p>"), (3, None)], "page_id long, html string")
    got = {r["page_id"]: r for r in documents.extract_articles(df, "page_id").collect()}
    assert got[1]["pub_date"].isoformat() == "2024-07-24T15:20:00"
    assert got[2]["title"] == "" and got[2]["pub_date"] is None and got[3]["text"] == ""


def test_links_become_absolute_and_unique(spark):
    html = '<a href="/a.chn">1</a><a href="https://o.example/b.chn">2</a><a href="/a.chn">3</a><a href="/c.htm">4</a>'
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = documents.page_links(df, "page_id", r'href="([^"]+\.chn)"', "https://site.example").collect()
    assert [r["link"] for r in got] == ["https://site.example/a.chn", "https://o.example/b.chn"]


def test_transcript_with_tool_calls(spark):
    schema = "conv_id int, turn int, role string, text string, tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string"
    rows = [
        (1, 0, "user", "hi", None, None),
        (1, 1, "assistant", None, [("c1", "price", '{"a": 1}'), (None, None, None)], None),
        (1, 2, "tool", "42", None, "c1"),
    ]
    got = documents.transcripts(spark.createDataFrame(rows, schema)).first()["transcript"]
    assert got == (
        "## User:\n\nhi\n\n## Assistant:\n\n### Tool Calls:\n\n- **price** (ID: c1)\n Arguments: {\"a\": 1}\n\n"
        "- **unknown** (ID: unknown)\n Arguments: {}\n\n\n\n## Tool:\n\n42 (Response to: c1)"
    )


def test_long_conversation_comes_in_parts(spark):
    df = spark.range(25).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    parts = documents.transcripts(df, part_turns=10).orderBy("part").collect()
    joined = "\n\n".join(r["transcript"] for r in parts)
    assert len(parts) == 3 and joined == documents.transcripts(df).first()["transcript"]


@pytest.mark.parametrize("together", [1024, 2])
def test_nearest_matches_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(vectors, "QUERIES_TOGETHER", together)
    rng = np.random.default_rng(2)
    points = rng.normal(size=(400, 6)).round(2)
    points[50:90] = points[10:50]  # equal vectors: ties go by id
    points[7] = 0
    queries = [(f"q{i}", points[i * 11].tolist()) for i in range(5)]
    rows = [(i, p.tolist(), f"u{i % 60}") for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, url string").repartition(7)
    odd = [(900, [1.0], "x"), (901, [float("nan")] * 6, "x"), (902, None, "x"), (903, [1.0, None] * 3, "x")]
    df = df.unionByName(spark.createDataFrame(odd, df.schema))
    asked = spark.createDataFrame(queries + [("bad", [None] * 6), ("none", None)], "query_id string, embedding array<double>")
    got = vectors.nearest(df, asked, k=6, payload=["url"]).collect()
    assert {r["query_id"] for r in got} == {name for name, _ in queries}
    other = vectors.nearest(df, spark.createDataFrame([(1, [-2.0])], "query_id long, embedding array<double>"), k=6)
    assert [(r["vec_id"], r["score"]) for r in other.collect()] == [(900, -1.0)]
    unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
    for name, q in queries:
        scores = unit @ (np.array(q) / np.linalg.norm(q))
        order = sorted(range(400), key=lambda i: (-round(scores[i], 12), i))[:6]
        mine = sorted((r for r in got if r["query_id"] == name), key=lambda r: r["place"])
        assert [r["vec_id"] for r in mine] == order
        assert [r["url"] for r in mine] == [f"u{i % 60}" for i in order]
        assert mine[0]["score"] == pytest.approx(1.0)


def test_score_of_unreadable_and_exact_answers(spark):
    from tidemark.operators.evaluation import scored

    rows = [
        ("a", "<tool_call>x</tool_call>\\boxed{5} \\pm \\boxed{0.25}", 5.0, 0.0),
        ("b", "<tool_call>\\boxed{1} \\pm \\boxed{1}</tool_call>none", 5.0, 1.0),
        ("c", "\\boxed{x} \\pm \\boxed{1}", 5.0, 1.0),
        ("d", "\\boxed{900} \\pm \\boxed{1}", 5.0, 1.0),
    ]
    df = spark.createDataFrame(rows, "id string, response string, gt_mean double, gt_std double")
    got = {r["id"]: r for r in scored(df).collect()}
    pdf = spark.range(1).select(scoring.chi_square_density(F.lit(1))).first()[0]
    assert got["a"]["nll_score"] == pytest.approx(1.0) and got["a"]["total_score"] == pytest.approx(1 + pdf)
    assert got["b"]["total_score"] == -1.0 and got["b"]["error"] and got["c"]["total_score"] == -1.0
    assert got["d"]["nll_score"] == -1.0 and got["d"]["error"] is None


def test_suggestions_send_no_dimension_to_every_task(spark, tmp_path):
    """The tokens of a dimension grow with it, however small its files are."""
    from tidemark.operators import lookup

    dim = spark.createDataFrame([("P1", "red steel"), ("P2", "blue red"), ("P3", None)], "code string, name string")
    dim.write.parquet(f"{tmp_path}/dim")
    dim = spark.read.parquet(f"{tmp_path}/dim")
    requested = spark.createDataFrame([("red",), ("P1",), ("blue red",), ("none",)], "code string")
    found = lookup.suggestions(requested, dim, "code", "name")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("blue red", "P2", "blue red"), ("red", "P1", "red steel"), ("red", "P2", "blue red")]
