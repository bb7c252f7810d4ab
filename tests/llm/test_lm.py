import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm
from tidemark.llm.queries import fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
LEARNS = lambda key: fold(key) != 1


def tokens_of(text):
    return WORD.findall((text or "").translate(LOWER)) + [None]


def brute(rows, settings):
    """id -> (learned, n, known, N, base, score), by recursion over dictionaries."""
    learned = [k is None or zlib.crc32(str(k).encode()) % 5 != 1 for k, _ in rows]
    texts = [tokens_of(t) for _, t in rows]
    train = [t for t, y in zip(texts, learned) if y]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    ones, twos = sum(x == 1 for w, x in c.items() if w is not None), sum(x == 2 for w, x in c.items() if w is not None)
    cut = min(max(ones / max(1, ones + 2 * twos), 0.1), 0.9)
    inside = {w for w, x in c.items() if w is not None and x >= max(1, settings.word_share * n)} | {None}
    kept = {}
    for order in range(2, settings.order + 1):
        found = Counter()
        for t in train:
            padded = ["<begin>", *t]
            for i in range(order - 1, len(padded)):
                gram = tuple(padded[i - order + 1 : i + 1])
                if all(w == "<begin>" or w in inside for w in gram) and (order == 2 or gram[:-1] in kept):
                    found[gram] += 1
        kept |= {g: x for g, x in found.items() if x >= max(1, settings.gram_share * n)}

    def single(w):
        return 1.0 if not n else (c[w] - cut) / n if c[w] else cut * v / n

    def contexts(h):
        if len(h) == 1:
            return len(train) if h[0] == "<begin>" else c[h[0]]
        return kept[h]

    memo = {}

    def back(h):
        if h not in memo:
            follow = [g[-1] for g in kept if g[:-1] == h]
            spent = sum((kept[(*h, w)] - settings.discount) / contexts(h) for w in follow)
            known = sum(chance(w, h[1:]) for w in follow)
            memo[h] = max(1 - spent, 1e-9) / max(1 - known, 1e-9) if follow else 1.0
        return memo[h]

    def chance(w, h):
        if not h:
            return single(w)
        if (*h, w) in kept:
            return (kept[(*h, w)] - settings.discount) / contexts(h)
        if len(h) == 1 and h[0] != "<begin>" and h[0] not in inside:
            return single(w)
        if len(h) > 1 and h not in kept:
            return chance(w, h[1:])
        return back(h) * chance(w, h[1:])

    out = []
    for (key, _), y, t in zip(rows, learned, texts):
        padded = ["<begin>", *t]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        score = sum(math.log10(chance(padded[i], tuple(padded[max(0, i - settings.order + 1) : i]))) for i in range(1, len(padded)))
        out.append((key, y, len(t), sum(c[w] > 0 for w in t), n, base, score))
    return out


def same(spark, df, settings, monkeypatch, shard=4000):
    monkeypatch.setattr(lm, "SHARD_BYTES", shard)
    got = lm.score_texts(df, LEARNS, settings=settings).collect()
    want = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], settings)
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], abs=1e-6)


@pytest.mark.parametrize("settings", [lm.Settings(2, 0.01, 0.001), lm.Settings(3, 0.004, 0.0008), lm.Settings(4, 0.01, 0.0)])
def test_equals_brute_force(spark, settings, monkeypatch):
    rng = np.random.default_rng(settings.order)
    names = ["the", "of", "Cat", "dog", "sat", "on"] + [f"r{i}" for i in range(300)]
    rows = []
    for i in range(120):
        picks = np.where(rng.random(40) < 0.7, rng.integers(0, 6, 40), rng.integers(6, 306, 40))
        rows.append((i, " ".join(names[p] for p in picks[: rng.integers(1, 40)]) + (" the cat sat on the dog" if i % 3 else "")))
    same(spark, spark.createDataFrame(rows, "doc_id long, text string"), settings, monkeypatch)


def test_edges(spark, edge, nothing, monkeypatch):
    same(spark, edge.where("doc_id IS NULL OR doc_id NOT IN (6, 7)"), lm.Settings(3, 0.01, 0.001), monkeypatch)
    assert lm.score_texts(nothing, LEARNS).count() == 0
    none = lm.score_texts(edge, lambda key: F.lit(False)).collect()
    assert all(r.score == r.base_score == 0 and r.n_known == r.train_tokens == 0 for r in none)


def test_held_out_texts_are_likelier_than_by_the_base(documents):
    out = lm.score_texts(documents, LEARNS).where("NOT learned").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_every_ngram_counts_at_any_size(spark, monkeypatch):
    """Rare words in rare n-grams, in more tokens than the shares 1e-4 and 2e-6 keep them in."""
    assert lm.Settings().word_share == lm.Settings().gram_share == 0
    rows = [(i, "common filler " * 1000 + f"rare{i} pair{i} third{i}") for i in range(12)]
    rows += [(100 + i, f"rare{i} pair{i} third{i}") for i in range(12)]
    same(spark, spark.createDataFrame(rows, "doc_id long, text string"), lm.Settings(), monkeypatch, shard=20_000)
    out = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), LEARNS).where("doc_id >= 100 AND NOT learned")
    # A word seen once has a share of about 4e-5; in its n-grams it is far likelier than alone.
    assert all(r.score > r.base_score + 3 for r in out.collect() if r.n_known == 4)


def test_sums_name_contexts_by_short_numbers():
    """What shards give to the sums names a context in a byte or two, not by its hash."""
    texts = [" ".join(f"w{i * j % 97}" for i in range(300)) for j in range(1, 9)]
    table = pa.table({"text": texts, "learn": [True] * 8})
    grams = lm.Grams(table, 3)
    replies = []
    for k in (1, 2):
        keys = grams.keys[k][grams.asked(k, None)]
        told = lm._narrow(4 * grams.own[k][grams.asked(k, None)] + 3)  # all are in other shards as well
        replies.append({"part": k - 1, "counts": told, "names": lm._ranked(np.arange(len(keys)) + 2)})
    replies.append({"part": 2, "counts": lm._narrow(4 * grams.own[3] + 1), "names": b""})
    model = lm.Model(grams, pa.Table.from_pylist(replies), 1, lm.Settings(), lm.Totals(8, 2408, 98, 0.5))
    given = lm._given(model, 0, 1)
    assert [r["part"] for r in given] == [0, 1]
    for k, row in enumerate(given, 1):
        names = lm._unpacked(row["keys"])
        shared = int((model.kept[k] & model.several[k]).sum())
        assert len(names) == len(set(names.tolist())) == shared > 90
        assert len(row["keys"]) < 2 * shared + 9


def test_answers_are_stored_compact(spark):
    """Shards get the same answers for the contexts that they share; stored, these repeat."""
    import os

    import numpy as np

    from tidemark.llm.lm import _stored

    sums = bytearray(np.random.default_rng(1).random(20_000).tobytes())
    name = "spark.sql.parquet.compression.codec"
    before = spark.conf.get(name)
    table = _stored(spark.createDataFrame([(k, bytearray([k]) + sums) for k in range(8)], "shard long, sums binary").coalesce(1), "lm-test")
    assert spark.conf.get(name) == before
    assert sorted(bytes(r.sums) for r in table.collect()) == [bytes([k]) + bytes(sums) for k in range(8)]
    files = [f.replace("file://", "") for f in table.inputFiles()]
    assert sum(map(os.path.getsize, files)) < 2 * len(sums)


def test_only_needed_sums_are_answered(spark, monkeypatch):
    """Shards are told the sums of contexts that a text of theirs leaves by a failure arc, and no others."""
    stored, through = {}, lm._stored
    monkeypatch.setattr(lm, "_stored", lambda df, label: stored.setdefault(label, through(df, label)) if label == "lm-sums" else through(df, label))
    rows = [(i, " ".join(f"w{i * j % 89}" for j in range(200))) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lm, "SHARD_BYTES", 4000)
    assert lm.score_texts(df, lambda key: F.lit(True)).where("learned").count() == len(rows)
    assert stored.pop("lm-sums").where("part >= 0").count() == 0  # every n-gram was learned
    same(spark, df, lm.Settings(), monkeypatch)
    assert stored.pop("lm-sums").where("part >= 0").count() > 0


def test_short_words_are_hashed_together(monkeypatch):
    from tidemark.llm import words

    odd = ["a", "b", "ab", "ba", "a\x00", "\x00a", "é", "x" * 63, "x" * 64, "中文", "aa", "aaa"]
    long = ["x" * 65, "y" * 5000]
    want = dict(zip(odd + long, words.summed_hashes(pa.array(odd + long)).tolist()))
    assert len(set(want.values())) == len(odd + long)
    calls, one = [], words.hashes
    monkeypatch.setattr(words, "hashes", lambda x, seed=0: calls.extend(x.to_pylist()) or one(x, seed))
    grams = lm.Grams(pa.table({"text": [" ".join(odd), long[0]], "learn": [True, True]}), 1)
    assert calls == long[:1]
    assert set(grams.keys[1].tolist()) == {int(lm._BEGIN), int(lm._END), *(h for w, h in want.items() if w != long[1])}
    some = pa.array(["drop", *odd, "drop"]).slice(1, len(odd))  # a part of a larger array
    assert words.summed_hashes(some).tolist() == [want[w] for w in odd]


def test_numbers_of_hashes_are_those_of_unique():
    from tidemark.llm import words

    keys = np.random.default_rng(1).integers(0, 1 << 64, 5000, dtype=np.uint64)
    near = (np.uint64(7) << np.uint64(60)) + np.arange(300, dtype=np.uint64)[::-1] % np.uint64(11)  # upper bits agree
    for x in (keys, keys[:1], keys[:0], np.concatenate((keys, keys[::-1], near, near)), keys % np.uint64(9)):
        distinct, number, at = words.numbered(x)
        first, inverse = np.unique(x, return_inverse=True)
        assert distinct.tolist() == first.tolist() and number.tolist() == inverse.tolist() and x[at].tolist() == first.tolist()


def test_texts_are_read_once_for_each_answer(spark, monkeypatch):
    """Two passes count, one gives sums and scores; no other goes over the texts, whatever waits."""
    kind = type(spark.range(0))
    passes, grouped = [], kind.groupBy
    monkeypatch.setattr(kind, "groupBy", lambda df, *x: passes.append({"shard", "text"} <= set(df.columns)) or grouped(df, *x))
    rows = [(i, " ".join(f"w{i * j % 89}" for j in range(50))) for i in range(1, 60)]
    lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), LEARNS).collect()
    assert sum(passes) == 3
