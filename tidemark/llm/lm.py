"""Scores of texts by a backoff language model over all n-grams of the corpus.

The weights are those of a backoff automaton: kept n-grams as arcs, and for a token without one
the weight of the failure arc to the shorter context. They are filled in for all places of a shard
at once, order by order; no state is carried along a text.
"""

from __future__ import annotations

import math
import pickle
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import words
from tidemark.llm.slices import stored_slices, text_bytes
from tidemark.sources.workspace import through_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Texts are dealt into shards of about so many bytes; a shard's words meet in one task.
SHARD_BYTES = 8 << 20
#: N-grams of up to so many tokens are counted together, those of more after those of one less.
_BLIND = 2
#: Hashes of a text's begin and end, and the factor that a context's hash takes for one more token.
_BEGIN, _END, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Settings:
    """A word takes part in n-grams from max(1, ``word_share`` of the training tokens) occurrences
    on, an n-gram is kept from max(1, ``gram_share``). By default every word and every n-gram seen
    in training takes part, at any size, so the model grows with the corpus."""

    order: int = 3
    word_share: float = 0.0
    gram_share: float = 0.0
    discount: float = 0.75


@dataclass(frozen=True)
class Totals:
    """Of the training texts: how many there are, their tokens (ends included), distinct tokens,
    and what unigrams are discounted."""

    texts: int
    tokens: int
    kinds: int
    cut: float

    def singles(self, c: np.ndarray) -> np.ndarray:
        """Unigram probabilities of tokens that occur ``c`` times."""
        if not self.tokens:
            return np.ones(len(c))
        return np.where(c > 0, (c - self.cut) / self.tokens, self.cut * self.kinds / self.tokens)


def _narrow(values: np.ndarray) -> bytes:
    """Counts as a byte each; those of 255 or more follow in eight bytes."""
    values = values.astype("<i8")
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].tobytes()


def _wide(held: bytes, n: int) -> np.ndarray:
    values = np.frombuffer(held, np.uint8, n).astype(np.int64)
    values[values == 255] = np.frombuffer(held, "<i8", offset=n)
    return values


def _sum_bytes(sums: np.ndarray) -> bytes:
    """Two rows of whole numbers and one of floats."""
    return sums[2].tobytes() + _narrow(sums[:2].ravel())


def _sums_in(held: bytes, n: int) -> np.ndarray:
    return np.vstack([_wide(held[8 * n :], 2 * n).reshape(2, n), np.frombuffer(held, "<f8", n)])


def _packed(keys: np.ndarray) -> bytes:
    """Sorted distinct hashes: the bytes of a step, the first hash, and the steps between them."""
    steps = np.diff(keys)
    width = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 1
    return bytes([width]) + keys[:1].tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(held: bytes) -> np.ndarray:
    width = held[0]
    steps = np.frombuffer(held, np.uint8, offset=9).reshape(-1, width)
    keys = np.zeros((len(steps) + 1, 8), np.uint8)
    keys[0], keys[1:, :width] = np.frombuffer(held, np.uint8, 8, 1), steps
    return np.cumsum(keys.view("<u8").ravel(), dtype=np.uint64)


def _ranked(ranks: np.ndarray) -> bytes:
    """Ascending numbers, from 2 on, as steps of mostly a byte each."""
    return _narrow(np.diff(ranks, prepend=1))


def _ranks(held: bytes, n: int) -> np.ndarray:
    return 1 + np.cumsum(_wide(held, n))


class Grams:
    """The n-grams of a shard's texts.

    Tokens stand in a row, each text between a begin and an end. ``which[k]`` has for each place
    the number of the n-gram of k tokens that ends there (-1 where the text has not so many
    tokens yet), ``keys[k]`` the sorted hashes of these n-grams, ``at[k]`` a place of each and
    ``own[k]`` how often it occurs in the shard's training texts. What precedes the last token of
    the n-gram at a place is the n-gram of k - 1 at the place before, its ending that of k - 1
    at the same place.
    """

    def __init__(self, table: pa.Table, order: int):
        codes, distinct, offsets = words.split_words(table.column("text").combine_chunks(), lower=True)
        texts = len(offsets) - 1
        self.sizes = np.diff(offsets) + 1
        self.begins = offsets[:-1] + 2 * np.arange(texts)
        self.ends = offsets[1:] + 2 * np.arange(texts) + 1
        length = len(codes) + 2 * texts
        word = np.ones(length, bool)
        word[self.begins] = word[self.ends] = False
        hashed = np.empty(length, np.uint64)
        hashed[word] = words.summed_hashes(distinct)[codes]
        hashed[self.begins], hashed[self.ends] = _BEGIN, _END
        self.learn = np.repeat(table.column("learn").to_numpy(), self.sizes + 1)
        depth = np.arange(length) - np.repeat(self.begins, self.sizes + 1)
        self.which, self.keys, self.at, self.own = {}, {}, {}, {}
        joint = hashed
        for k in range(1, order + 1):
            if k > 1:
                joint = words.mixed(np.concatenate((joint[:1], joint[:-1])) * _STEP + hashed)
            there = np.flatnonzero(depth >= k - 1)
            keys, number, first = words.numbered(joint[there])
            which = np.full(length, -1, np.int32)
            which[there] = number
            self.which[k], self.keys[k], self.at[k] = which, keys, there[first]
            self.own[k] = np.bincount(number[self.learn[there]], minlength=len(keys))

    def asked(self, k: int, several: np.ndarray | None) -> np.ndarray:
        """Which n-grams of ``k`` tokens may be in other shards: all but a begin or end alone, and
        if it is known which of k - 1 tokens are in ``several``, those whose two parts are."""
        if k == 1:
            return (self.keys[1] != _BEGIN) & (self.keys[1] != _END)
        if k <= _BLIND or several is None:
            return np.ones(len(self.keys[k]), bool)
        at, which = self.at[k], self.which[k - 1]
        return several[which[at]] & several[which[at - 1]]

    def told(self, held: dict[int, bytes], k: int, ranges: int, several: np.ndarray | None, texts: int):
        """Of the n-grams of ``k`` tokens: counts over all training texts, which this shard gives
        to sums over all, and which are in several shards."""
        keys, ask = self.keys[k], self.asked(k, several)
        if k == 1:
            count, first, several = np.full(len(keys), texts, np.int64), np.zeros(len(keys), bool), np.ones(len(keys), bool)
        else:
            count, first, several = self.own[k].astype(np.int64), self.own[k] > 0, np.zeros(len(keys), bool)
        asked = np.flatnonzero(ask)
        for part, a, b in _parts(keys[asked], k, ranges):
            got, place = _wide(held[part], b - a), asked[a:b]
            count[place], first[place], several[place] = got >> 2, got & 1, got & 2
        return count, first, several


class Model:
    """What a shard's n-grams weigh; contexts are the kept n-grams shorter than the order.

    ``count[k]`` are counts over all training texts, ``several[k]`` says which n-grams other
    shards have too. ``kept[k]`` are the arcs (for one token: the words in n-grams) with
    probabilities ``chance[k]``. A token without an arc follows the failure arc from its context
    to that without the first token, for the context's weight.
    """

    def __init__(self, grams: Grams, replies: pa.Table, ranges: int, settings: Settings, totals: Totals):
        self.grams, self.settings, self.totals = grams, settings, totals
        self.count, self.several, self.kept, self.chance, self.spent, self.needs = {}, {}, {}, {}, {}, {}
        parts = replies.column("part").to_pylist()
        held = dict(zip(parts, replies.column("counts").to_pylist()))
        self.names = dict(zip(parts, replies.column("names").to_pylist()))
        for k, keys in grams.keys.items():
            count, first, several = grams.told(held, k, ranges, self.several.get(k - 1), totals.texts)
            self.count[k], self.several[k] = count, several
            at, which = grams.at[k], grams.which
            if k == 1:
                least = max(1, settings.word_share * totals.tokens)
                alone = (keys == _BEGIN) | (keys == _END)
                self.kept[1] = np.where(alone, totals.texts > 0, count >= least)
                self.chance[1] = totals.singles(count)
                inside = self.kept[1]
                continue
            before, last = which[k - 1][at - 1], which[1][at]
            inside = inside[before] & self.kept[1][last]
            self.kept[k] = inside & (count >= max(1, settings.gram_share * totals.tokens))
            self.chance[k] = (count - settings.discount) / np.maximum(self.count[k - 1][before], 1)
            # The contexts that a failure arc leaves from at some place of the shard.
            self.needs[k - 1] = np.zeros(len(grams.keys[k - 1]), bool)
            self.needs[k - 1][before[~self.kept[k]]] = True
            # Of the arcs of each context: counts, how many, and what their tokens have without its first.
            here = np.flatnonzero(self.kept[k] & first)
            lower, n = self.chance[k - 1][which[k - 1][at[here]]], len(grams.keys[k - 1])
            taken = (self.count[k][here], np.ones(len(here)), lower)  # np.bincount of nothing has integers
            self.spent[k - 1] = np.stack([np.bincount(before[here], x, n).astype(float) for x in taken])

    def shared(self, k: int, ranges: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Contexts of ``k`` tokens that are in other shards' texts as well: by parts, the numbers
        that all shards know them by, ascending, and where they are."""
        keys, name = self.grams.keys[k], np.zeros(len(self.grams.keys[k]), np.int64)
        asked = np.flatnonzero(self.grams.asked(k, self.several.get(k - 1)))
        for part, a, b in _parts(keys[asked], k, ranges):
            place = asked[a:b][self.several[k][asked[a:b]]]
            name[place] = _ranks(self.names[part], len(place))
        if k == 1:  # a begin and an end, which are not asked for
            name[keys == _END] = 1
        some = np.flatnonzero(self.kept[k] & self.several[k])
        for part, a, b in _parts(keys[some], k, ranges):
            place = some[a:b][np.argsort(name[some[a:b]])]
            yield part, name[place], place

    def needed(self, k: int, ranges: int) -> Iterator[tuple[int, np.ndarray]]:
        """Contexts of ``k`` tokens whose sums the shard is told, by parts and in the order told."""
        for part, _, place in self.shared(k, ranges):
            place = place[self.needs[k][place]]
            if len(place):
                yield part, place

    def scores(self, ranges: int) -> tuple[np.ndarray, dict[int, tuple]]:
        """Log10-probabilities of the tokens at all places, without the weights of failure arcs
        whose sums other shards share in. These wait, by tokens of the context: how many contexts
        of each part, their counts, and the places with the number of the context each waits for."""
        which, order, discount = self.grams.which, self.settings.order, self.settings.discount
        logs, longest, waits = np.log10(self.chance[1])[which[1]], np.ones(len(which[1]), np.int8), {}
        for k in range(2, order + 1):
            back = weights(self.spent[k - 1], self.count[k - 1], discount)
            back[~self.kept[k - 1]] = 0  # no such state
            needed = list(self.needed(k - 1, ranges))
            context = np.concatenate([place for _, place in needed]) if needed else np.zeros(0, np.int64)
            back[context], number = 0, np.full(len(back), -1, np.int32)
            number[context] = np.arange(len(context))
            at = np.flatnonzero(which[k] >= 0)
            gram, before = which[k][at], which[k - 1][at - 1]
            kept = self.kept[k][gram]
            arc = np.log10(np.maximum(self.chance[k], 1e-300))
            logs[at] = np.where(kept, arc[gram], logs[at] + back[before])
            longest[at[kept]] = k
            wait = ~kept & (number[before] >= 0)
            parts = [(part, len(place)) for part, place in needed]
            waits[k - 1] = parts, self.count[k - 1][context], at[wait], number[before[wait]]
        for k, (parts, counts, at, number) in waits.items():
            last = longest[at] <= k  # no longer n-gram there is an arc
            waits[k] = parts, counts, at[last], number[last]
        return logs, waits


def weights(spent: np.ndarray, count: np.ndarray, discount: float) -> np.ndarray:
    """Log10 of the weights of failure arcs, from the sums over the arcs of contexts."""
    taken, arcs, known = spent
    spent = (taken - discount * arcs) / np.maximum(count, 1)
    return np.log10(np.maximum(1 - spent, 1e-9) / np.maximum(1 - known, 1e-9))


def _parts(keys: np.ndarray, k: int, ranges: int) -> Iterator[tuple[int, int, int]]:
    """Parts of sorted hashes of n-grams of ``k`` tokens, by ranges: number, from, to."""
    place = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(place.astype(np.int64), prepend=-1, append=-2))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield (k - 1) * ranges + int(place[a]), int(a), int(b)


_ASKED = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_TOLD = pa.schema([
    ("part", pa.int32()), ("shard", pa.int64()), ("counts", pa.binary()), ("names", pa.binary()), ("total", pa.int64()), ("kinds", pa.int64()),
    ("ones", pa.int64()), ("twos", pa.int64()),
])


def _merged(table: pa.Table) -> tuple[pa.Table, list[np.ndarray], np.ndarray, np.ndarray]:
    """A part's rows by shard, their hashes, each hash's number among the distinct, and where rows begin."""
    table = table.sort_by("shard")
    keys = [_unpacked(x) for x in table.column("keys").to_pylist()]
    _, number, _ = words.numbered(np.concatenate(keys))
    return table, keys, number, np.cumsum([0, *map(len, keys)])


def _counts(dealt: DataFrame, orders: range, ranges: int, order: int, replies: DataFrame | None = None) -> DataFrame:
    """Counts of n-grams of ``orders`` over all training texts, for each shard in the order of its
    hashes. ``replies`` are the counts of shorter ones: what they show to be in no other shard is
    not sent, for its shard has the count.

    ``counts`` are four times the count, and 1 more in the first shard that learns the n-gram,
    which gives it to sums over all, and 2 more if several shards have it. ``names`` number those of
    several shards within their part, if they are shorter than ``order``: sums name them so. The row with shard -1 has a part's ``total``, ``kinds``, ``ones`` and ``twos`` if it is one of words.
    """

    def ask(table: pa.Table, right: pa.Table | None = None) -> pa.Table:
        words.hand_back()
        if not table.num_rows:
            return pa.Table.from_pylist([], _ASKED)
        grams, shard, rows, several = Grams(table, orders[-1]), table.column("shard")[0].as_py(), [], None
        held = dict(zip(right.column("part").to_pylist(), right.column("counts").to_pylist())) if right else {}
        for k in range(_BLIND, orders[0]):
            several = grams.told(held, k, ranges, several, 0)[2]
        for k in orders:
            asked = grams.asked(k, several)
            keys, own = grams.keys[k][asked], grams.own[k][asked]
            for part, a, b in _parts(keys, k, ranges):
                rows.append({"part": part, "shard": shard, "keys": _packed(keys[a:b]), "counts": _narrow(own[a:b])})
        return pa.Table.from_pylist(rows, _ASKED)

    def count(table: pa.Table) -> pa.Table:
        words.hand_back()
        table, keys, number, cuts = _merged(table)
        own = np.concatenate([_wide(x, len(y)) for x, y in zip(table.column("counts").to_pylist(), keys)])
        total = np.bincount(number, own).astype(np.int64)
        learned, place = np.flatnonzero(own)[::-1], np.full(len(total), -1)
        place[number[learned]] = learned  # the last to be set is the first there
        first = np.zeros(len(own), bool)
        first[place[place >= 0]] = True
        several = np.bincount(number) > 1
        told, rank = 4 * total[number] + 2 * several[number] + first, 1 + np.cumsum(several)
        part, none = table.column("part")[0].as_py(), {"total": 0, "kinds": 0, "ones": 0, "twos": 0}

        def names(own: np.ndarray) -> bytes:
            return _ranked(rank[own[several[own]]]) if part < (order - 1) * ranges else b""

        rows = [
            {"part": part, "shard": s, "counts": _narrow(told[a:b]), "names": names(number[a:b]), **none}
            for s, a, b in zip(table.column("shard").to_pylist(), cuts[:-1], cuts[1:])
        ]
        if part < ranges:
            kinds, ones, twos = (total > 0).sum(), (total == 1).sum(), (total == 2).sum()
            sums = {"total": int(total.sum()), "kinds": int(kinds), "ones": int(ones), "twos": int(twos)}
            rows.append({"part": part, "shard": -1, "counts": b"", "names": b"", **sums})
        return pa.Table.from_pylist(rows, _TOLD)

    def ask_more(left: pa.Table, right: pa.Table) -> pa.Table:
        return ask(left, right)

    def ask_all(table: pa.Table) -> pa.Table:
        return ask(table)

    rows = "part int, shard long, keys binary, counts binary"
    if replies is None:
        asked = dealt.groupBy("shard").applyInArrow(ask_all, rows)
    else:
        asked = dealt.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(ask_more, rows)
    schema = "part int, shard long, counts binary, names binary, total long, kinds long, ones long, twos long"
    return asked.groupBy("part").applyInArrow(count, schema)


def _given(model: Model, shard: int, ranges: int) -> list[dict]:
    """What a shard gives to the sums of contexts that others have too: by names times two, and 1
    more where it needs the sums itself."""
    rows = []
    for k in range(1, model.settings.order):
        for part, names, place in model.shared(k, ranges):
            sums = _sum_bytes(model.spent[k][:, place])
            keys = 2 * names.astype(np.uint64) + model.needs[k][place]
            rows.append({"part": part, "shard": shard, "keys": _packed(keys), "counts": sums})
    return rows


def _scored(model: Model, texts: pa.Table, ranges: int) -> bytes:
    """The shard's rows, with scores that lack the weights which wait, and these: how many wait in
    each text, and for which."""
    grams, totals = model.grams, model.totals
    log, waits = model.scores(ranges)
    count, begins = model.count[1][grams.which[1]], grams.begins
    plain = np.log10(count + 0.5) - math.log10(totals.tokens + 0.5 * (totals.kinds + 1))
    known = (count > 0).astype(np.int64)
    log[begins] = plain[begins] = known[begins] = 0
    log, plain, known = (np.add.reduceat(x, begins) for x in (log, plain, known))
    rows = pa.table({
        "id": texts.column("id"), "learned": texts.column("learn"), "n_tokens": grams.sizes, "n_known": known,
        "train_tokens": np.full(len(known), totals.tokens, np.int64), "base_score": plain, "score": log,
    })
    held = {}
    for k, (parts, counts, at, number) in waits.items():
        each = np.diff(np.searchsorted(at, np.append(begins, len(grams.learn)))).astype(np.int32)
        held[k] = parts, _narrow(counts), each, number
    return pickle.dumps((rows, held))


def _completed(scored: bytes, sums: dict[int, bytes], discount: float) -> pa.Table:
    """The rows of ``_scored`` with the weights that waited."""
    rows, waits = pickle.loads(scored)
    score = rows.column("score").to_numpy().copy()
    for parts, counts, each, number in waits.values():
        if parts:
            told = np.hstack([_sums_in(sums[part], n) for part, n in parts])
            back = weights(told, _wide(counts, told.shape[1]), discount)
            score += np.bincount(np.repeat(np.arange(len(score)), each), back[number], len(score))
    return rows.set_column(rows.schema.get_field_index("score"), "score", pa.array(score))


def _sums(dealt: DataFrame, replies: DataFrame, settings: Settings, totals: Totals, ranges: int) -> DataFrame:
    """What the arcs of contexts in several shards take in all, for each shard that needs it, and
    in rows with a negative part what ``_scored`` says of a shard.

    A context's sums matter only where a text leaves it by its failure arc, in an n-gram that no
    training text has; no other sums are answered.
    """

    def give(left: pa.Table, right: pa.Table) -> pa.Table:
        words.hand_back()
        rows = []
        if left.num_rows:
            model, shard = Model(Grams(left, settings.order), right, ranges, settings, totals), left.column("shard")[0].as_py()
            rows = _given(model, shard, ranges)
            apart = -1 - int(words.mixed(np.array([shard], np.uint64))[0] >> np.uint64(33))  # spreads shards over tasks
            rows.append({"part": apart, "shard": shard, "keys": b"", "counts": _scored(model, left, ranges)})
        return pa.Table.from_pylist(rows, _ASKED)

    def add(table: pa.Table) -> pa.Table:
        words.hand_back()
        if table.column("part")[0].as_py() < 0:
            return table.select(["part", "shard", "counts"]).rename_columns(["part", "shard", "sums"])
        table = table.sort_by("shard")
        keys = [_unpacked(x) for x in table.column("keys").to_pylist()]
        given = np.hstack([_sums_in(x, len(y)) for x, y in zip(table.column("counts").to_pylist(), keys)])
        cuts, keys = np.cumsum([0, *map(len, keys)]), np.concatenate(keys)
        names, needs = (keys >> np.uint64(1)).astype(np.int64), (keys & np.uint64(1)).astype(bool)
        both = np.stack([np.bincount(names, x)[names[needs]] for x in given])
        cuts = np.concatenate(([0], np.cumsum(needs)))[cuts]
        sums = [_sum_bytes(both[:, a:b]) if a < b else None for a, b in zip(cuts[:-1], cuts[1:])]
        told = {"part": table.column("part"), "shard": table.column("shard"), "sums": pa.array(sums, pa.binary())}
        return pa.table(told).drop_null()

    given = dealt.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(
        give, "part int, shard long, keys binary, counts binary"
    )
    return given.groupBy("part").applyInArrow(add, "part int, shard long, sums binary")


def _stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` through a compact table, whose shuffles are deleted when it is written."""
    conf, ours = df.sparkSession.conf, {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    before = {name: conf.get(name, None) for name in ours}
    for name, value in ours.items():
        conf.set(name, value)
    try:
        return through_table(df, label)
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def score_texts(
    docs: DataFrame,
    learns: Callable[[Column], Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """Log10-probabilities of all texts by a model of those for whose id ``learns`` holds.

    Tokens are words after folding A-Z, then one end per text. Counts cover every training
    text, and every n-gram seen is kept. Texts are stored once, in shards by position, and each
    pass reads them in place. The n-grams of a shard of texts go to tasks by ranges
    of their 64-bit hashes, which answer with the counts over all texts, in the same order; the
    weights of contexts that several shards learn are added up the same way. So a task holds
    the n-grams of one shard or one range, and nothing is gathered by the driver but totals.
    A token's probability is that of the longest kept n-gram, with absolute discounting and
    backoff; the unigrams give what they are discounted to the one class of unknown words.

    Returns per input row ``id_col``, ``learned``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (unigrams with half a count added) and ``score``. A null text is the end
    alone. Rows with a null id are learned from unless ``learns`` says false. Repeated rows
    count and are scored each. Without training texts every token is unknown, and both scores
    are 0. An empty table gives no rows; other columns are not looked at.
    """
    size, texts = text_bytes(docs, text_col), docs.where(F.coalesce(learns(F.col(id_col)), F.lit(True))).count()
    shards = max(1, math.ceil(size / SHARD_BYTES))
    dealt = stored_slices(docs, id_col, text_col, size, SHARD_BYTES).select(
        F.col("slice").alias("shard"),
        "id",
        F.coalesce(learns(F.col("id")), F.lit(True)).alias("learn"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    told = _stored(_counts(dealt, range(1, min(_BLIND, settings.order) + 1), shards, settings.order), "lm-counts")
    total, kinds, ones, twos = (
        x or 0 for x in told.where("shard = -1").agg(F.sum("total"), F.sum("kinds"), F.sum("ones"), F.sum("twos")).first()
    )
    cut = min(max(ones / max(1, ones + 2 * twos), 0.1), 0.9)  # what unigrams are discounted
    totals = Totals(texts, total + texts, kinds + (texts > 0), cut)
    replies = told.where("shard >= 0").select("part", "shard", "counts", "names")
    for k in range(_BLIND + 1, settings.order + 1):
        more = _stored(_counts(dealt, range(k, k + 1), shards, settings.order, replies), "lm-counts")
        replies = replies.unionByName(more.select("part", "shard", "counts", "names"))
    sums = _stored(_sums(dealt, replies, settings, totals, shards), "lm-sums")
    kind = docs.schema[id_col].dataType.simpleString()

    def score(rows: pa.Table) -> pa.Table:
        words.hand_back()
        sums = dict(zip(rows.column("part").to_pylist(), rows.column("sums").to_pylist()))
        return _completed(sums[min(sums)], sums, settings.discount)

    schema = f"id {kind}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = sums.groupBy("shard").applyInArrow(score, schema)
    return scored.withColumnRenamed("id", id_col)
