from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import repeats
from tidemark.llm.repeats import Parsing, remove_repeats


def brute(rows, length):
    """(id, n_bytes, spans, kept) by looking at every string."""
    seen = defaultdict(int)
    texts = [(k, (t or "").encode()) for k, t in rows]
    for _, data in texts:
        for i in range(len(data) - length + 1):
            seen[data[i : i + length]] += 1
    out = []
    for key, data in texts:
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            if seen[data[i : i + length]] > 1:
                gone[i : i + length] = True
        spans, start = [], None
        for i, g in enumerate(gone):
            if g and start is None:
                start = i
            elif not g and start is not None:
                spans.append((start, i - start))
                start = None
        out.append((key, len(data), tuple(spans), bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=repr)


def ours(df, parsing):
    out = remove_repeats(df, parsing=parsing).collect()
    return sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.length) for s in r.spans), bytes(r.kept)) for r in out), key=repr)


def same(spark, rows, parsing, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 3000)
    monkeypatch.setattr(repeats, "SLICE_BYTES", 700)
    got = ours(spark.createDataFrame(rows, "doc_id long, text string"), parsing)
    want = brute(rows, parsing.length)
    assert got == want
    return want


@pytest.mark.parametrize("parsing", [Parsing(20, 12, 4), Parsing(20, 16, 5), Parsing(20, 1, 3), Parsing(7, 3, 2)])
def test_random_texts_over_small_alphabets(spark, parsing, monkeypatch):
    rng = np.random.default_rng(parsing.window)
    rows = []
    for i in range(60):
        letters = ["ab", "abcdefghij é", "a"][i % 3]
        text = "".join(rng.choice(list(letters), rng.integers(0, 90 if i % 3 else 25)))
        if rows and i % 4 == 0:
            other = rows[rng.integers(len(rows))][1]
            cut = int(rng.integers(0, max(1, len(other) - 30)))
            text = text[: len(text) // 2] + other[cut : cut + int(rng.integers(15, 45))] + text[len(text) // 2 :]
        rows.append((i, text))
    assert any(spans for _, _, spans, _ in same(spark, rows, parsing, monkeypatch))


def test_passages_at_all_lengths_around_the_limit(spark, monkeypatch):
    rng = np.random.default_rng(9)
    text = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    rows = []
    for i, n in enumerate([199, 200, 201, 250, 330]):
        passage = text(n)
        rows += [(10 * i + k, text(300 + k) + passage + text(280 - k)) for k in range(3)]
    chain = text(400)  # AB here, BC there: one covered run, though ABC occurs nowhere else
    rows += [(90, text(50) + chain[:260] + text(50)), (91, text(50) + chain[140:] + text(30)), (92, text(9) + chain)]
    rows += [(93, "x" * 450), (94, "é" * 150), (95, "xy" * 99)]
    want = {k: spans for k, _, spans, _ in same(spark, rows, Parsing(), monkeypatch)}
    assert not want[0] and want[10][0][1] == 200 and want[92] == ((9, 400),) and want[93] == ((0, 450),)


def test_edges(spark, edge, nothing):
    assert ours(nothing, Parsing()) == []
    assert ours(edge, Parsing(8, 4, 3)) == brute(
        [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()], 8
    )
