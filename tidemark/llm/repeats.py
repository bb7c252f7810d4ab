"""Removal of repeated byte strings by prefix-free parsing.

Rolling-hash triggers cut every text into overlapping phrases, such that each string of
``length`` bytes starts in exactly one phrase and the phrase and place depend on the string
alone. The dictionary is the set of distinct phrases, the parse says how often and where each
occurs. The corpus order of suffixes, cut off at ``length`` bytes, then follows from both: two
strings are neighbours with that common prefix if and only if they start at equal places of
phrases that agree there. Only whether such a neighbour exists is needed, so the order itself
is never materialised: phrases are grouped by the trigger's key, and only the suffixes of
phrases that differ under one key are compared, by 64-bit fingerprints.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import words
from tidemark.llm.slices import stored_slices, text_bytes
from tidemark.sources.workspace import through_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Texts are dealt into shards of about so many bytes.
SHARD_BYTES = 8 << 20
#: Texts are hashed in slices of about so many bytes (some 60 bytes of memory each).
SLICE_BYTES = 1 << 20
_WHOLE, _MIXED, _STRING = 1, 2, 3


@dataclass(frozen=True)
class Parsing:
    """A trigger is the least hash of ``gram`` bytes among ``window`` places, the first of ties.

    A string of ``length`` bytes holds all grams of one such window, so equal strings have
    their trigger at the same place, and the ``key`` bytes from there on lie in the string.
    """

    length: int = 200
    window: int = 160
    gram: int = 16

    def __post_init__(self):
        if not (self.window + self.gram - 1 <= self.length and self.window >= 1 and self.gram >= 1):
            raise ValueError("window + gram - 1 must not exceed length")

    @property
    def key(self) -> int:
        return self.length - self.window + 1


_FACTOR = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the factor and of its inverse, modulo 2^64."""
    if "up" not in _POWERS or len(_POWERS["up"]) <= n:
        for name, base in (("up", _FACTOR), ("down", pow(_FACTOR, -1, 1 << 64))):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


class Phrases:
    """Phrases of some concatenated texts: ``first`` to ``last`` are the places where the
    strings of a phrase start, ``trigger`` is its trigger; ``text`` the text it belongs to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, parsing: Parsing):
        self.parsing, n = parsing, len(data)
        up, self.down = _powers(n)
        values = words.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_FACTOR))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * up[:n], out=self.sums[1:])
        valid = np.zeros(n, bool)
        for a, b in zip(offsets[:-1], offsets[1:]):
            if b - a >= parsing.length:
                valid[a : b - parsing.length + 1] = True
        place = np.flatnonzero(valid)
        del valid
        if not len(place):
            self.first = self.last = self.trigger = self.text = np.zeros(0, np.int64)
            return
        at = np.arange(n - parsing.gram + 1)
        least = words.mixed(self.hash(at, at + parsing.gram))
        least = (least & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        del at
        width = 1
        while width < parsing.window:  # the least of ever wider windows
            more = min(width, parsing.window - width)
            least = np.minimum(least[: len(least) - more], least[more:])
            width += more
        trigger = (least[place] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.diff(trigger)) + 1
        begin, end = np.concatenate(([0], cut)), np.append(cut, len(place)) - 1
        self.first, self.last, self.trigger = place[begin], place[end], trigger[begin]
        self.text = np.searchsorted(offsets, self.first, side="right") - 1

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Fingerprint of the bytes from start to stop."""
        return (self.sums[stop] - self.sums[start]) * self.down[start]

    def keys(self) -> np.ndarray:
        return words.mixed(self.hash(self.trigger, self.trigger + self.parsing.key)).view(np.int64)

    def bodies(self) -> np.ndarray:
        whole = self.hash(self.first, self.last + self.parsing.length)
        return words.mixed(whole + (self.last - self.first).astype(np.uint64)).view(np.int64)

    def strings(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and fingerprints of all strings that start in the chosen phrases."""
        first, sizes = self.first[chosen], (self.last - self.first + 1)[chosen]
        upto = np.cumsum(sizes)
        place = np.repeat(first - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)
        return place, words.mixed(self.hash(place, place + self.parsing.length)).view(np.int64)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes behind each other, and where each begins."""
    wide = texts.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    held = wide.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _known(table: pa.Table, kind: int) -> np.ndarray:
    """Sorted values of one kind in rows of (kind, values)."""
    lists = table.column("values").combine_chunks()
    kinds = np.repeat(table.column("kind").to_numpy(), np.diff(lists.offsets.to_numpy()))
    return np.sort(lists.flatten().to_numpy()[kinds == kind])


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))


def _merge(table: pa.Table) -> pa.Table:
    """Of one range of fingerprints, those that two shards hold or one twice, by shard.

    The lowest bit of a fingerprint says that its shard holds it twice.
    """
    lists = table.column("values").combine_chunks()
    value = lists.flatten().to_numpy().view(np.uint64)
    shard = np.repeat(table.column("shard").to_numpy(), np.diff(lists.offsets.to_numpy()))
    order = np.argsort(value, kind="stable")
    value, shard = value[order], shard[order]
    first = np.flatnonzero(np.diff(value >> np.uint64(1), prepend=~(value[:1] >> np.uint64(1))))
    several = np.diff(np.append(first, len(value))) > 1
    twice = np.bitwise_or.reduceat(value & np.uint64(1), first).astype(bool) if len(first) else several
    keep = np.repeat(several | twice, np.diff(np.append(first, len(value))))
    value, shard = value[keep] & ~np.uint64(1), shard[keep]
    order = np.argsort(shard, kind="stable")
    names, sizes = np.unique(shard, return_counts=True)
    return pa.table({"shard": names.astype(np.int64), "values": _lists(value[order].view(np.int64), sizes)})


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among) or not len(values):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _covered(phrases: Phrases, whole: np.ndarray, mixed: np.ndarray, strings: np.ndarray, size: int) -> np.ndarray:
    """Which bytes lie in a repeated string: starts add one, and take it away ``length`` later."""
    change = np.zeros(size + 1, np.int32)
    keys = phrases.keys()
    some = _member(keys, whole)
    np.add.at(change, phrases.first[some], 1)
    np.add.at(change, phrases.last[some] + phrases.parsing.length, -1)
    place, found = phrases.strings(np.flatnonzero(_member(keys, mixed)))
    place = place[_member(found & ~1, strings)]
    np.add.at(change, place, 1)
    np.add.at(change, place + phrases.parsing.length, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parsing: Parsing = Parsing()
) -> DataFrame:
    """Remove each byte covered by a string of ``parsing.length`` bytes that also starts elsewhere.

    Texts are UTF-8; strings never cross texts; occurrences may overlap and may be in one text;
    what is repeated is judged on the input. Texts are stored once, in shards by position, and
    never shuffled. Three passes read the shards in place: the first counts trigger keys and
    whether their phrases are all equal; the second fingerprints the strings of phrases that
    are not; the third removes. Keys and strings are counted over the whole
    corpus and sent only to the shards that hold them, of which a list is as long as there are
    shards at most.

    Returns per input row ``id_col``, ``n_bytes``, ``spans`` (start and length of the maximal
    removed runs, in bytes) and ``kept`` (the other bytes, binary, for a cut may lie within a
    character). A null text counts as empty. Rows that repeat others are repeats of each other
    even with equal ids. Texts shorter than a string stay whole. An empty table gives no rows;
    other columns are not looked at.
    """
    size = text_bytes(docs, text_col)
    shards = max(1, math.ceil(size / SHARD_BYTES))
    stored = stored_slices(docs, id_col, text_col, size, SHARD_BYTES)
    dealt = stored.select(F.col("slice").alias("shard"), "id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 1, SLICE_BYTES):
                data, offsets = _bytes_of(part.column(1))
                phrases = Phrases(data, offsets, parsing)
                shard = part.column(0).to_numpy()[phrases.text] if len(phrases.text) else np.zeros(0, np.int64)
                body = phrases.bodies() if len(shard) else np.zeros(0, np.int64)
                key = phrases.keys() if len(shard) else np.zeros(0, np.int64)
                told = body ^ words.mixed(shard.astype(np.uint64) + np.uint64(1)).view(np.int64)
                _, where, times = np.unique(told, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[where]), pa.array(body[where]), pa.array(shard[where]), pa.array(times.astype(np.int64))],
                    ["key", "body", "shard", "n"],
                )

    parsed = dealt.select("shard", "text").mapInArrow(parse, "key long, body long, shard long, n long")
    keys = parsed.groupBy("key").agg(
        F.sum("n").alias("n"), F.min("body").alias("low"), F.max("body").alias("high"), F.collect_set("shard").alias("shards")
    )
    keys = keys.where("n > 1").select(
        "shards", "key", F.when(F.col("low") == F.col("high"), _WHOLE).otherwise(_MIXED).alias("kind")
    )
    keys = through_table(keys, "repeat-keys").select(
        F.explode("shards").alias("shard"), F.array("key").alias("values"), "kind"
    )

    # Fingerprints travel in arrays, by ranges of their values, of which a task merges one.
    ranges = np.uint64(2 * shards)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        mixed = _known(right, _MIXED)
        found = [np.zeros(0, np.int64)]
        for batch in left.select(["shard", "text"]).combine_chunks().to_batches() if len(mixed) else []:
            for part in words.slices(batch, 1, SLICE_BYTES):
                phrases = Phrases(*_bytes_of(part.column(1)), parsing)
                if len(phrases.first):
                    found.append(phrases.strings(np.flatnonzero(_member(phrases.keys(), mixed)))[1])
        value, times = np.unique(np.concatenate(found).view(np.uint64) & ~np.uint64(1), return_counts=True)
        place = ((value >> np.uint64(32)) * ranges) >> np.uint64(32)
        names, sizes = np.unique(place, return_counts=True)
        shard = left.column("shard")[0].as_py() if left.num_rows else 0
        value |= (times > 1).astype(np.uint64)
        return pa.table(
            {"range": names.astype(np.int64), "shard": np.full(len(names), shard, np.int64), "values": _lists(value.view(np.int64), sizes)}
        )

    strings = (
        dealt.select("shard", "text")
        .groupBy("shard")
        .cogroup(keys.where(F.col("kind") == _MIXED).groupBy("shard"))
        .applyInArrow(compare, "range long, shard long, values array<long>")
        .groupBy("range")
        .applyInArrow(_merge, "shard long, values array<long>")
    )
    strings = through_table(strings, "repeat-strings").select("shard", "values", F.lit(_STRING).alias("kind"))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        whole, mixed, strings = (_known(right, k) for k in (_WHOLE, _MIXED, _STRING))
        rows: list[tuple] = []
        for batch in left.select(["id", "text"]).combine_chunks().to_batches():
            for part in words.slices(batch, 1, SLICE_BYTES):
                data, offsets = _bytes_of(part.column(1))
                phrases = Phrases(data, offsets, parsing)
                gone = _covered(phrases, whole, mixed, strings, len(data)) if len(phrases.first) else np.zeros(len(data), bool)
                for key, a, b in zip(part.column(0).to_pylist(), offsets[:-1], offsets[1:]):
                    mine = gone[a:b]
                    if mine.any():
                        edges = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
                        spans = [{"start": int(x), "length": int(y - x)} for x, y in zip(edges[::2], edges[1::2])]
                        rows.append((key, int(b - a), spans, data[a:b][~mine].tobytes()))
                    else:
                        rows.append((key, int(b - a), [], data[a:b].tobytes()))
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        kinds = [left.schema.field("id").type, pa.int64(), span, pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "n_bytes", "spans", "kept"])

    schema = f"id {kind}, n_bytes long, spans array<struct<start: long, length: long>>, kept binary"
    removed = dealt.groupBy("shard").cogroup(keys.unionByName(strings).groupBy("shard")).applyInArrow(remove, schema)
    return removed.withColumnRenamed("id", id_col)
