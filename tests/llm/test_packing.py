import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm.packing import Encoder, Windows, pack_sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


ODD = [
    "Don't can'T 3.14 <|endoftext|> x<|startoftext|>y", "é é ́x İ ẞ ΑΣ Σ\x1ck\x85p​q ﬁ Ⅷ ²", "À×÷ÿ_ªº­µ",
    None, "", " \x0b\x0c\r\n", "\U0001f600 中文字 हिन्दी", "<|", "a<|b|>'s'LL", "\x00\x7f",
]


def test_ids_are_the_tokenizers(tokenizer, documents):
    texts = ODD + [r.text for r in documents.select("text").limit(60).collect()]
    with open(PATH, encoding="utf-8") as file:
        got = list(Encoder(file.read()).encode(pa.array(texts), 1))
    for text, ids in zip(texts, got):
        assert list(ids) == ids_of(tokenizer, text), repr(text)[:80]


def test_characters_are_spelled_once(tokenizer, monkeypatch):
    """New parts outside ASCII are not sent through the byte-level step one by one."""
    from tokenizers import pre_tokenizers

    calls, kind = [], pre_tokenizers.ByteLevel

    class Counted:
        def __init__(self, **how):
            self.step = kind(**how)

        def pre_tokenize_str(self, text):
            calls.append(text)
            return self.step.pre_tokenize_str(text)

    monkeypatch.setattr(pre_tokenizers, "ByteLevel", Counted)
    with open(PATH, encoding="utf-8") as file:
        encoder = Encoder(file.read())
    calls.clear()
    plain = [chr(i) for i in [*range(0x21, 0x7F), *range(0xC0, 0x100)] if encoder.PLAIN.fullmatch(chr(i))]
    texts = [f"{a}{b}x {b}É{a} é{a}" for a, b in zip(plain, reversed(plain))] * 2
    for text, ids in zip(texts, encoder.encode(pa.array(texts), 1)):
        assert list(ids) == ids_of(tokenizer, text), text
    assert not calls


def check(tokenizer, df):
    texts = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        texts[r.doc_id].append(ids_of(tokenizer, r.text))
    pieces = pack_sequences(df, PATH).collect()
    places, documents = defaultdict(list), defaultdict(lambda: defaultdict(int))
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length > 0
        places[p.sequence_id].append((p.offset, p.length))
        whole = [t for t in texts[p.doc_id] if len(t) == p.doc_tokens and t[p.start : p.start + p.length] == ids.tolist()]
        assert whole
        documents[p.doc_id][p.start] += p.length
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    for key, lists in texts.items():
        assert sum(map(len, lists)) == sum(documents[key].values())
    used = sum(p.length for p in pieces)
    return used, len(places)


def test_round_trip(tokenizer, documents):
    used, sequences = check(tokenizer, documents)
    assert sequences * 2048 - used < 2048 * documents.rdd.getNumPartitions()


def test_edges(tokenizer, edge, nothing):
    check(tokenizer, edge)
    assert pack_sequences(nothing, PATH).count() == 0


def test_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(3)
    windows = Windows(64, 0)
    for _ in range(2000):
        size = int(rng.integers(1, 64))

        def cost(level):
            counts = windows.counts.copy()
            counts[level] -= bool(level)
            counts[level + size] += 1
            return int((counts[1:64] ** 2).sum())

        choices = {level: cost(level) for level in range(0, 65 - size) if level == 0 or windows.counts[level]}
        assert choices[windows.best_level(size)] == min(choices.values())
        windows.place((0, 0, size, np.zeros(size, np.int32)))
    left = sum(len(p[-1]) for level in windows.levels for held in level for p in held)
    closed = [sum(len(p[-1]) for p in held) for held in windows.close()]
    assert sum(closed) == left and all(n == 64 for n in closed[:-1])


def test_crc_matches(spark):
    data = np.array([5, 70000, 1], "<u4").tobytes()
    got = spark.createDataFrame([(bytearray(data),)], "ids binary").selectExpr("crc32(ids) c").first().c
    assert got == zlib.crc32(data)


def test_waiting_windows_are_bounded(tokenizer, spark, monkeypatch):
    """Rests above half a window find no partner; beyond a bound they fill each other up."""
    from tidemark.llm import packing

    monkeypatch.setattr(packing, "MOST_HELD_IDS", 20_000)
    rows = [(i, " ".join(["a"] * 1500)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    used, sequences = check(tokenizer, df)
    assert sequences * 2048 - used < 2048 * (used // 20_000 + 1)


def test_parts_are_remembered_over_a_tasks_texts(tokenizer, monkeypatch):
    """A part that returns after many others is not looked up again; a full memory begins anew."""
    letters = "abcdefghij"
    parts = [f"{a}{b}{c}{d}{e}" for a in letters[:6] for b in letters for c in letters for d in letters for e in letters]
    with open(PATH, encoding="utf-8") as file:
        spec = file.read()
    text = " ".join(parts)
    want = ids_of(tokenizer, text)
    for most, times in ((Encoder.MOST_PARTS, 1), (1000, 2)):
        monkeypatch.setattr(Encoder, "MOST_PARTS", most)
        encoder, looked = Encoder(spec), []
        part = encoder._part
        monkeypatch.setattr(encoder, "_part", lambda x, part=part, looked=looked: looked.append(x) or part(x))
        for texts in ([text], [text + " " + parts[0]]):
            assert list(next(encoder.encode(pa.array(texts), 1)))[: len(want) - 1] == want[:-1]
        assert len(encoder.known) <= most
        assert len(looked) == times * len(parts)


def test_parts_of_many_words_are_cut_together(tokenizer, monkeypatch):
    """Plain words are not split one by one; contractions, digits and marks go as the tokenizer's file says."""
    import itertools
    import re

    pattern = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    with open(PATH, encoding="utf-8") as file:
        encoder = Encoder(file.read())
    some = ["".join(x) for n in range(1, 5) for x in itertools.product("'sLrev1!É", repeat=n)]
    parts, counts = encoder._cut(pa.array(["before", *some]).slice(1))
    parts, at = parts.to_pylist(), 0
    for word, n in zip(some, counts):
        assert parts[at : at + n] == pattern.findall(word.lower()), word
        at += n
    assert at == len(parts)
    texts = [" ".join(some[i::7]) for i in range(7)] + ["", None, "<|endoftext|> 'S"]
    for text, ids in zip(texts, encoder.encode(pa.array(texts), 1)):
        assert list(ids) == ids_of(tokenizer, text)
    for few in ([None], ["", " "], ["中文 <|"], []):
        assert [x.tolist() for x in encoder.encode(pa.array(few, pa.string()), 1)] == [ids_of(tokenizer, x) for x in few]


def test_a_tasks_parts_are_not_forgotten(monkeypatch):
    """400,000 parts, as a task of the check meets them, are each looked up once."""
    with open(PATH, encoding="utf-8") as file:
        encoder = Encoder(file.read())
    looked = []

    class Model:
        def tokenize(self, part):
            looked.append(part)
            return []

    encoder.model = Model()
    letters = "abcdefghijklmnopqrst"
    text = " ".join(a + b + c + d for a in letters for b in letters for c in letters[:10] for d in letters) + " "
    text += " ".join("x" + a + b + c + d for a in letters for b in letters for c in letters for d in letters[:20])
    text += " " + " ".join("y" + a + b + c + d for a in letters for b in letters for c in letters for d in letters[:20])
    for _ in range(2):
        list(encoder.encode(pa.array([text]), 1))
    assert len(looked) == len(set(looked)) == 400_000
