import bisect
import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import align
from tidemark.llm.align import Encoders, align_tokenizers, byte_level_bytes, linked_groups

FIRST, SECOND = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


@pytest.fixture(scope="module")
def encoders():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(FIRST, encoding="utf-8") as spec, open(SECOND, "rb") as model:
        return Encoders(spec.read(), model.read())


def whole(text, encoders):
    """Groups of (first ids, second ids) by encoding the whole text, or none."""
    chars = byte_level_bytes()
    e = encoders.first.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(chars[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
    b = []
    for i in encoders.second.encode(text):
        piece = encoders.second.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if encoders.second.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return []
    ends = [list(np.cumsum([len(x) for _, x in side])) for side in (a, b)]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        x, y = (bisect.bisect_right(side, end) for side in ends)
        groups.append(([t for t, _ in a[i:x]], [t for t, _ in b[j:y]]))
        i, j = x, y
    return groups


def brute(rows, encoders):
    cut = [whole(t, encoders) if t else [] for _, t in rows]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in cut]
    counts = Counter(pair for found in links for pair in found)
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for (key, _), groups, found in zip(rows, cut, links):
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(n for p, n in found.items() if counts[p] == top[p[0]])
        out.append(
            (key, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(found.values()),
             best, sum(n * counts[p] for p, n in found.items()), told)
        )
    return sorted(out, key=repr)


def ours(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in align_tokenizers(df, FIRST, SECOND).collect()), key=repr)


def test_units_are_what_the_whole_text_has(encoders):
    """Random texts of white space, marks, digits and many scripts, cut and whole."""
    assert encoders.cuttable
    rng = np.random.default_rng(1)
    parts = [" ", "  ", "\n", "\t ", "a", "The", "'s", "don't", "123", "?!", "...", "é", "中文", "日本", " ", "　",
             "​", "🙂", "é", "▁", "<|endoftext|>", "</s>", "<0x41>", "\x00", "\x1c", "\x85", "ß", "Ωmega", "0.5"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(1, 12)))
        units = encoders.units(text)
        assert " ".join(units) == text
        first, second = (sum(ids, []) for ids in zip(*([i.tolist() for i in encoders.encode(u)] for u in units)))
        assert first == encoders.first.encode(" " + text, add_special_tokens=False).ids
        # The second reads a literal mark of its blanks as a blank: such texts are never restored.
        assert "▁" in text or second == encoders.second.encode(text)


def test_pointer_jumping_equals_common_ends():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n)), n)) for _ in (0, 1)]
        common = np.intersect1d(*ends)
        for side, labels in zip(ends, linked_groups(*ends)):
            assert labels.tolist() == np.searchsorted(common, side).tolist()


def test_one_long_chain_converges():
    """No common end but the last: one group over all tokens."""
    n = 5000
    a, b = np.append(np.arange(1, 2 * n, 2), 2 * n), np.append(np.arange(2, 2 * n, 2), 2 * n)
    labels = linked_groups(a, b)
    assert not labels[0].any() and not labels[1].any()


def test_tables(spark, documents, encoders, monkeypatch):
    monkeypatch.setattr(align, "STORED_BYTES", 60_000)
    monkeypatch.setattr(align, "LOT_BYTES", 5_000)
    monkeypatch.setattr(align, "PART_UNITS", 700)
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = ours(documents.repartition(3))
    assert got == brute(rows, encoders)
    assert any(n > g for _, n, _, g, *_ in got)


def test_odd_texts_and_large_groups(spark, encoders, monkeypatch):
    monkeypatch.setattr(align, "STORED_BYTES", 200)
    monkeypatch.setattr(align, "PLAIN_PAIRS", 1)
    rows = [(1, "a▁b c"), (1, "x y"), (2, "x y"), (2, "x y"), (None, "x y"), (None, None), (3, ""), (4, " "), (5, "   a  b "),
            (6, "\n\n\t"), (7, "=" * 301), (8, "ab" * 200 + " tail"), (9, "中文字" * 50), (10, "🙂🙂 🙂"), (11, "<|endoftext|> </s> <0x41>"),
            (12, "  x　 y"), (13, "x▁"), (14, "1234567890" * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    df = df.selectExpr("*", "1 AS id", "2 AS slice", "3 AS groups", "4 AS n_a", "5 AS pair")
    want = brute(rows, encoders)
    assert ours(df) == want
    assert (1, 0, 0, 0, 0, 0, 0, "") in want and any(links > groups > 0 for _, _, _, groups, links, *_ in want)


def test_edges(edge, nothing, encoders):
    assert ours(edge) == brute([(r.doc_id, r.text) for r in edge.collect()], encoders)
    assert ours(nothing) == []


def test_other_tokenizer_files_are_not_cut(encoders):
    """A file that looks across blanks takes whole texts."""
    import json

    spec = json.loads(encoders.first.to_str())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    with open(SECOND, "rb") as model:
        other = Encoders(json.dumps(spec), model.read())
    assert not other.cuttable and other.units("a b c") == ["a b c"]
