import re

import numpy as np
import pytest

from tidemark.llm import slices, windows
from tidemark.llm.windows import remove_repeated_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    """(id, number of words, spans, kept) by looking at every window."""
    texts = [(windows.NO_ID if k is None else k, WORD.findall(t or "")) for k, t in rows]
    least = {}
    for key, w in texts:
        for i in range(len(w) - width + 1):
            window = tuple(w[i : i + width])
            least[window] = min(least.get(window, key), key)
    out = []
    for (key, _), (rank, w) in zip(rows, texts):
        gone = [False] * (len(w) + 1)
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < rank:
                gone[i : i + width] = [True] * width
        spans, start = [], None
        for i, g in enumerate(gone):
            if g and start is None:
                start = i
            elif not g and start is not None:
                spans.append((start, i - start))
                start = None
        out.append((key, len(w), tuple(spans), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def ours(df, width=13):
    out = remove_repeated_windows(df, width=width).collect()
    return sorted(
        ((r.doc_id, r.n_words, tuple((s.start, s.length) for s in r.spans), r.kept) for r in out), key=repr
    )


@pytest.mark.parametrize("width", [1, 2, 5])
def test_random_texts_over_few_words(spark, width, monkeypatch):
    """Many ranges and slices of a few texts each."""
    monkeypatch.setattr(slices, "STORED_BYTES", 400)
    monkeypatch.setattr(windows, "RANGE_BYTES", 900)
    rng = np.random.default_rng(width)
    few = ["a", "b", "c", "é", "中", "X", "x"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(few, rng.integers(0, 25)))
        if rows and i % 5 == 0:
            text = text[: len(text) // 2] + " " + (rows[rng.integers(len(rows))][1] or "") + "\t" + text
        rows.append((int(rng.integers(0, 90)), text))
    want = brute(rows, width)
    assert ours(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), width) == want
    assert any(spans for _, _, spans, _ in want) and any(w and not spans for _, w, spans, _ in want)


def test_windows_across_and_within_slices(spark, monkeypatch):
    """Passages of 12 words stay, of 13 go, overlapping ones merge, and the first document keeps all."""
    monkeypatch.setattr(slices, "STORED_BYTES", 3000)
    monkeypatch.setattr(windows, "RANGE_BYTES", 5000)
    rng = np.random.default_rng(3)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    rows = []
    for i, n in enumerate([12, 13, 14, 60]):
        passage = text(n)
        rows += [(10 * (i + 1) + k, " ".join(text(40 + k) + passage + text(30 - k))) for k in range(4)]
    chain = text(50)
    rows += [(90, " ".join(text(5) + chain[:30])), (91, " ".join(chain[17:] + text(3))), (92, " ".join(text(2) + chain))]
    rows += [(93, "same " * 40), (94, "same\n" * 20), (7, "same " * 12)]
    want = {k: (spans, kept) for k, _, spans, kept in brute(rows, 13)}
    assert ours(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)) == brute(rows, 13)
    assert not want[10][0] and not want[11][0] and not want[20][0] and want[21][0] == ((41, 13),)
    assert want[92][0] == ((2, 50),) and want[94] == (((0, 20),), "") and not want[93][0]


def test_tables(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert ours(documents.repartition(4)) == brute(rows, 13)


def test_edges(edge, nothing):
    """Null and equal ids, null and long texts, clashing columns, an empty table."""
    extra = edge.selectExpr("*", "1 AS slice", "2 AS spans", "3 AS n_words")
    for width in (3, 13):
        assert ours(extra, width) == brute([(r.doc_id, r.text) for r in edge.collect()], width)
    assert ours(nothing) == []


def test_text_is_not_shuffled(spark, documents):
    """The stored texts are read in place by the cogroups."""
    plan = remove_repeated_windows(documents)._jdf.queryExecution().executedPlan().toString()
    side = plan.split("Exchange")
    assert "Bucketed: true" in plan and len(side) == 2 and "text" not in side[1]
