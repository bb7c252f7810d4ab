import itertools
import random
import re

import pytest

from tidemark.llm.components import connected_components
from tidemark.llm.near_dedup import Sketch, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    """(id, n, component) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and min(len(a), len(b)) * 100 >= max(len(a), len(b)) * 75:
            common = len(a & b)
            if common * 100 >= 75 * (len(a) + len(b) - common):
                parent[root(i)] = root(j)
    ids = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[root(i)] = min(ids.get(root(i), key), key)
    return sorted(
        ((k, len(s), ids.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=repr
    )


def ours(df, sketch=Sketch()):
    out = near_duplicates(df, sketch=sketch).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr)


def test_equals_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    want = brute(rows)
    assert ours(documents) == want
    assert any(k != c for k, _, c in want)


def test_edges(edge, nothing):
    assert ours(edge) == brute([(r.doc_id, r.text) for r in edge.collect()])
    assert ours(nothing) == []


def test_chains_with_distant_ends(spark):
    """Neighbours are similar, ends are not: one component through links between others."""
    words = [f"t{i}" for i in range(220)]
    rows = [(100 + k, " ".join(words[8 * k : 8 * k + 100])) for k in range(15)]
    rows += [(k, f"alone {k} " * 10) for k in range(5)]
    want = brute(rows)
    assert ours(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert sum(c == 100 for _, _, c in want) == 15


@pytest.mark.parametrize("links", [[(1, 2), (2, 3), (9, 8), (3, 10), (5, 5)], [(i, i + 1) for i in range(40)]])
def test_components(spark, links):
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    parent = {}
    for a, b in links:
        if a != b:
            ra = {n for n in parent if parent[n] == parent.get(a, a)} | {a}
            rb = {n for n in parent if parent[n] == parent.get(b, b)} | {b}
            for n in ra | rb:
                parent[n] = min(ra | rb)
    assert {r.node: r.root for r in got} == parent
    assert len(got) == len(parent)


def test_large_buckets_are_joined_by_rare_shingles(spark, documents, edge):
    """Texts that share most of a passage meet in buckets; links among them must not be lost."""
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(k, passage + " " + " ".join(f"own{k}x{i}" for i in range(45 + k % 9))) for k in range(40)]
    rows += [(100 + k, rows[k][1] + " end") for k in range(0, 40, 4)]
    rows += [(200 + k, " ".join(rows[k][1].split()[:-9])) for k in range(1, 40, 5)]
    rare = Sketch(most_paired=2)
    want = brute(rows)
    assert 1 < len({c for _, _, c in want}) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ours(df, rare) == ours(df) == want
    assert ours(edge, rare) == brute([(r.doc_id, r.text) for r in edge.collect()])
    docs = documents.selectExpr("doc_id", "text")
    assert ours(docs, Sketch(most_paired=1)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_members_meet_only_where_enough_follows(spark, monkeypatch):
    """Copies of one text that each lost and gained a few words resemble it, but hardly each other:
    few of their pairs may reach the full sets, and of each a row alone."""
    from tidemark.llm import near_dedup

    rng = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(90):
        text = list(base)
        for at in rng.sample(range(400), 12 + k % 3):
            text[at] = f"own{k}x{at}"
        rows.append((k, " ".join(text)))
    rows += [(100 + k, rows[k][1] + " end") for k in range(0, 90, 9)]
    held, store = {}, near_dedup.through_table

    def through_table(df, label, *more):
        held[label] = store(df, label, *more)
        return held[label]

    monkeypatch.setattr(near_dedup, "through_table", through_table)
    want = brute(rows)
    assert 1 < len({c for _, _, c in want}) < len(rows)
    assert ours(spark.createDataFrame(rows, "doc_id long, text string"), Sketch(most_paired=2)) == want
    pairs = held.get("near-apart-pairs", held.get("near-rare-pairs"))
    nodes = held["near-apart"].select("key").distinct().count()
    assert pairs.count() == pairs.distinct().count() < 4 * nodes


def test_copies_of_one_text_meet_at_it(spark, monkeypatch):
    """Copies that were each edited elsewhere all link to their text but not to each other: it is
    the hub of their buckets, so none is left to be compared with the others."""
    from tidemark.llm import near_dedup

    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(1, 80):
        text = list(base)
        for at in rng.sample(range(0, 300, 5), 7):
            text[at] = f"own{k}x{at}"
        rows.append((k, " ".join(text)))
    left, store = [], near_dedup.through_table

    def through_table(df, label, *more):
        table = store(df, label, *more)
        if label == "near-apart":
            left.append(table.count())
        return table

    monkeypatch.setattr(near_dedup, "through_table", through_table)
    want = brute(rows)
    assert {c for _, _, c in want} == {0}
    assert ours(spark.createDataFrame(rows, "doc_id long, text string"), Sketch(most_paired=2)) == want
    assert left == [0]


def test_only_shingles_at_which_sets_may_meet_become_rows(spark):
    """Of sets of 40 shingles, 30 of them common to all, a row each for the first 11 at most."""
    from tidemark.llm.near_dedup import _rare

    rng = random.Random(2)
    shingles = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(30 + 50 * 10)]
    rows = [(k, k, sorted(shingles[:30] + shingles[30 + 10 * k : 40 + 10 * k])) for k in range(50)]
    got = _rare(spark.createDataFrame(rows, "key long, root long, shingles array<long>"), Sketch()).collect()
    assert {r.shingle for r in got} <= {x for _, _, own in rows for x in own}
    assert 50 <= len(got) < 100 and all(r.rest >= 30 and r.key == r.root for r in got)
    common = [{r.shingle for r in got if r.key == k} & set(shingles[:30]) for k in range(50)]
    assert all(x == common[0] for x in common) and len(common[0]) == 1
