import hashlib
import re

import pytest

from tidemark.llm import exact_dedup
from tidemark.llm.exact_dedup import exact_duplicates


def brute(rows):
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (key, _), text in zip(rows, texts):
        ids = [k for (k, _), t in zip(rows, texts) if t == text]
        known = [k for k in ids if k is not None]
        keep = min(known) if known else None
        out.append((key, keep if len(ids) > 1 else key, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def ours(df, **options):
    out = exact_duplicates(df, digest_all=True, **options).collect()
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=repr)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_edges_with_and_without_broadcast(edge, nothing, monkeypatch, most):
    monkeypatch.setattr(exact_dedup, "MOST_BROADCAST_GROUPS", most)
    assert ours(edge) == brute([(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()])
    assert ours(nothing) == []


def test_equal_lengths_and_prefixes_are_not_copies(spark):
    rows = [(1, "abcX"), (2, "abcY"), (3, "abc\tX"), (4, "abc X"), (5, "abc  Y"), (6, "abc Y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ours(df, prefix_chars=3) == brute(rows)
    few = {r.doc_id: r.text_sha256 for r in exact_duplicates(df, prefix_chars=4).collect()}
    assert few[1] is None and few[3] == few[4] is not None


@pytest.mark.parametrize("bits", [6, 7, 26])
def test_a_full_filter_changes_nothing(spark, edge, documents, monkeypatch, bits):
    """With few bits nearly every row passes; results are those of an empty filter."""
    rows = [(1, "abcX"), (2, "abcY"), (3, "abc\tX"), (4, "abc X"), (5, "q"), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", bits)
    out = {r.doc_id: (r.keep_id, r.text_sha256 is None) for r in exact_duplicates(df, prefix_chars=4).collect()}
    assert out == {1: (1, True), 2: (2, True), 3: (3, False), 4: (3, False), 5: (5, True), 6: (6, False), 7: (6, False)}
    assert ours(edge) == brute([(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()])


def test_struct_ids_tell_rows_apart(spark):
    df = spark.createDataFrame([(5, "a"), (5, "a"), (5, "b"), (None, "a")], "doc_id long, text string")
    keyed = df.selectExpr("struct(doc_id IS NULL AS nameless, doc_id, monotonically_increasing_id() AS row) AS key", "text")
    assert exact_duplicates(keyed, "key").where("kept").count() == 2
