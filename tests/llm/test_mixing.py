import re
from collections import defaultdict

import pytest

from tidemark.llm.mixing import mix_sources, source_targets


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what exceeds a cap is dealt out again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, got, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(got.values())
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not above:
            got |= {s: weight[s] * level for s in open_}
            break
        got |= {s: float(most * sizes[s]) for s in above}
        open_ -= above
    return got


@pytest.mark.parametrize(
    "sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 5, "d": 0, "é": 70, None: 300}, {None: 4}, {"a": 100, "b": 1, "c": 1, "d": 1}]
)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df, (5, 2, 1), 3).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def check(df):
    out = mix_sources(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((repr(r.doc_id), r.size) for r in out) == sorted((repr(r.doc_id), size(r.text)) for r in df.collect())
    sources = defaultdict(int)
    for r in out:
        sources[r.source] += r.size
    want, taken, longest = targets(sources), defaultdict(int), defaultdict(int)
    for r in out:
        assert r.source_size == sources[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    assert sum(taken.values()) <= sum(sources.values())
    key = lambda r: (repr(r.doc_id), r.size, repr(r.source), r.taken)
    assert sorted(map(key, mix_sources(df.repartition(5)).collect())) == sorted(map(key, out))
    return {s: (taken[s], want[s], longest[s]) for s in sources}


def test_near_targets(documents):
    for taken, target, longest in check(documents).values():
        assert abs(taken - target) <= longest + 0.1 * target


def test_a_hot_source(spark):
    rows = [(i, "w " * (1 + i % 7), "hot" if i % 3 else f"s{i % 4}") for i in range(3000)]
    for taken, target, longest in check(spark.createDataFrame(rows, "doc_id long, text string, source string")).values():
        assert abs(taken - target) <= 2 * longest


def test_edges(edge, nothing):
    check(edge)
    assert mix_sources(nothing).count() == 0
    blank = mix_sources(edge.where("trim(coalesce(text, '')) = ''")).collect()
    assert blank and all(r.taken == r.copies == 0 for r in blank)
