"""Removal of word windows that an earlier document has, by Rabin-Karp hashes counted in Spark.

Every window of words has two rolling hashes of 64 bits. Slices of text send 32 bits of the
first for each distinct window to the range of hashes it lies in; only windows whose short hash
two slices share are sent with the second as well and with their document. Windows count as
equal when range, short hash and second hash are: about 100 bits. What a document must remove goes back to its
slice, where the windows merge into maximal runs of words.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from tidemark.llm import words
from tidemark.llm.slices import stored_slices, text_bytes
from tidemark.sources.workspace import through_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Text per range of hashes; a task merges a range, some four million short hashes.
RANGE_BYTES = 24 << 20
#: A null id counts as greater than all others.
NO_ID = np.iinfo(np.int64).max
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes, modulo 2^64, of all ``width`` values in a row.

    A running sum of value * base^place gives each window by one difference; dividing by
    base^start (bases are odd) makes it independent of the place.
    """
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * np.multiply.accumulate(steps), out=sums[1:])
    steps[1:] = pow(base, -1, 1 << 64)
    back = np.multiply.accumulate(steps)[: n - width + 1]
    return words.mixed((sums[width:] - sums[:-width]) * back)


class Windows:
    """The windows of some texts: ``start`` (word), ``key`` (range and short hash), ``check``
    and ``doc``, in the order of the texts; ``codes``, ``distinct``, ``offsets`` are the words."""

    def __init__(self, ids: pa.Array, texts: pa.Array, width: int, ranges: int):
        import xxhash

        self.codes, self.distinct, self.offsets = words.split_words(texts)
        digest = xxhash.xxh3_128_digest
        named = b"".join([digest(w) for w in self.distinct.cast(pa.binary()).to_pylist()])
        pairs = np.frombuffer(named, np.uint64).reshape(-1, 2)
        sizes = np.maximum(np.diff(self.offsets) - width + 1, 0)
        upto = np.cumsum(sizes)
        self.start = np.repeat(self.offsets[:-1] - (upto - sizes), sizes) + np.arange(sizes.sum())
        value, self.check = (rolling(pairs[self.codes, i], width, _BASES[i])[self.start] for i in (0, 1))
        place = ((value >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        self.key = (place << np.uint64(32)) | (value & np.uint64(0xFFFFFFFF))
        plain = ids.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.doc = np.repeat(plain, sizes)

    def grouped(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the chosen windows by hash, where each distinct hash begins in it, and the
        smallest document of each."""
        order = chosen[np.lexsort((self.check[chosen], self.key[chosen]))]
        key, check = self.key[order], self.check[order]
        first = np.flatnonzero((np.diff(key, prepend=~key[:1]) != 0) | (np.diff(check, prepend=~check[:1]) != 0))
        least = np.minimum.reduceat(self.doc[order], first) if len(first) else self.doc[:0]
        return order, first, least


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))


def _by_range(key: np.ndarray, number: int, **columns: np.ndarray) -> pa.Table:
    """A row per range for hashes sorted by key."""
    place, sizes = np.unique(key >> np.uint64(32), return_counts=True)
    lists = {name: _lists(column, sizes) for name, column in columns.items()}
    return pa.table(
        {
            "range": place.astype(np.int64),
            "slice": np.full(len(place), number, np.int64),
            "shorts": _lists(key.astype(np.uint32).view(np.int32), sizes),
            **lists,
        }
    )


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _sizes(table: pa.Table) -> np.ndarray:
    return pc.list_value_length(table.column("shorts")).to_numpy()


def _keys(table: pa.Table) -> np.ndarray:
    """Keys of the rows in the order of their ranges."""
    place = np.repeat(table.column("range").to_numpy().astype(np.uint64), _sizes(table))
    return (place << np.uint64(32)) | _flat(table, "shorts").view(np.uint32)


def shared_shorts(table: pa.Table) -> pa.Table:
    """Of one range, the short hashes that several slices have, by slice."""
    short, sizes = _flat(table, "shorts"), _sizes(table)
    order = np.argsort(short, kind="stable")
    same = short[order][1:] == short[order][:-1]
    kept = np.zeros(len(short), bool)
    kept[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    row = np.repeat(np.arange(len(sizes)), sizes)[kept]
    left = np.bincount(row, minlength=len(sizes))
    some = np.flatnonzero(left)
    return pa.table(
        {
            "slice": table.column("slice").combine_chunks().take(pa.array(some)),
            "range": table.column("range").combine_chunks().take(pa.array(some)),
            "shorts": _lists(short[kept], left[some]),
        }
    )


def earlier_elsewhere(table: pa.Table) -> pa.Table:
    """Of one range, whether a slice's window also starts in a smaller document than its own."""
    short, check, doc = (_flat(table, c) for c in ("shorts", "checks", "docs"))
    told = np.zeros(len(short), bool)
    if len(short):
        order = np.lexsort((check, short))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(short[order]) != 0) | (np.diff(check[order]) != 0)
        least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
        told[order] = doc[order] > least[np.cumsum(new) - 1]
    return pa.table(
        {
            "slice": table.column("slice"),
            "range": table.column("range"),
            "shorts": table.column("shorts"),
            "told": _lists(told, _sizes(table)),
        }
    )


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among) or not len(values):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def cut(texts: Windows, gone: np.ndarray, width: int) -> tuple[pa.Array, pa.Array]:
    """Maximal runs of words covered by the windows marked ``gone``, and the texts without them."""
    offsets, n = texts.offsets, len(texts.codes)
    change = np.zeros(n + 1, np.int32)
    change[texts.start[gone]] += 1
    change[texts.start[gone] + width] -= 1  # starts are distinct, so are ends
    covered = np.cumsum(change[:-1]) > 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # a run ends with its text
    begins = np.flatnonzero(covered & (edge[:-1] | ~np.concatenate(([False], covered[:-1]))))
    ends = np.flatnonzero(covered & (edge[1:] | ~np.concatenate((covered[1:], [False])))) + 1
    text = np.searchsorted(offsets, begins, side="right") - 1
    sizes = np.bincount(text, minlength=len(offsets) - 1)
    runs = pa.StructArray.from_arrays([pa.array(begins - offsets[text]), pa.array(ends - begins)], ["start", "length"])
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), runs)
    before = np.concatenate(([0], np.cumsum(~covered)))[offsets]
    left = texts.distinct.take(pa.array(texts.codes[~covered]))
    kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), left), " ")
    return spans, kept


def remove_repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13
) -> DataFrame:
    """Remove each word covered by a window of ``width`` words that also starts in a document
    with a smaller id.

    Words are runs of anything but ASCII white space and stay as they are. Windows lie within a
    document and are judged on the input, not on what is left. Texts are stored once, in slices
    by position; three passes read the slices in place, and only hashes are shuffled: 32 bits of
    each distinct window of a slice, then 64 more and the document for those that several
    slices share. Hashes are dealt out by ranges of their values, which grow with the text.

    Returns per input row ``id_col``, ``n_words``, ``spans`` (start and length in words of the
    maximal removed runs) and ``kept`` (the other words, joined by one blank). Ids are integers;
    a null id counts as greater than all others. Rows with equal ids, or without id, do not
    remove each other's words. Null and empty texts, and texts shorter than a window, lose
    nothing; a text longer than a slice is a slice of its own. An empty table gives no rows;
    other columns are not looked at.
    """
    total = text_bytes(docs, text_col)
    ranges = max(1, math.ceil(total / RANGE_BYTES))
    stored = stored_slices(docs, id_col, text_col, total)
    kind = docs.schema[id_col].dataType.simpleString()

    def windows_of(table: pa.Table) -> Windows:
        table = table.select(["id", "text"]).combine_chunks()
        batch = table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)
        return Windows(batch.column(0), batch.column(1), width, ranges)

    def shorts(table: pa.Table) -> pa.Table:
        return _by_range(np.unique(windows_of(table).key), table.column("slice")[0].as_py())

    def full(texts: pa.Table, shared: pa.Table) -> pa.Table:
        found = windows_of(texts)
        order, first, least = found.grouped(np.flatnonzero(_member(found.key, _keys(shared.sort_by("range")))))
        top = order[first]
        number = texts.column("slice")[0].as_py() if texts.num_rows else 0
        return _by_range(found.key[top], number, checks=found.check[top].view(np.int64), docs=least)

    def remove(texts: pa.Table, answers: pa.Table) -> pa.Table:
        found, answers = windows_of(texts), answers.sort_by("range")
        order, first, least = found.grouped(np.arange(len(found.key)))
        told = np.zeros(len(first), bool)
        told[_member(found.key[order[first]], _keys(answers))] = _flat(answers, "told")
        sizes = np.diff(np.append(first, len(order)))
        gone = np.zeros(len(order), bool)
        gone[order] = np.repeat(told, sizes) | (found.doc[order] > np.repeat(least, sizes))
        spans, kept = cut(found, gone, width)
        words.hand_back()
        ids = texts.column("id").combine_chunks()
        return pa.table({"id": ids, "n_words": np.diff(found.offsets), "spans": spans, "kept": kept})

    by_range = stored.groupBy("slice").applyInArrow(shorts, "range long, slice long, shorts array<int>")
    shared = by_range.groupBy("range").applyInArrow(shared_shorts, "slice long, range long, shorts array<int>")
    shared = through_table(shared, "window-shorts")
    sent = (
        stored.groupBy("slice")
        .cogroup(shared.groupBy("slice"))
        .applyInArrow(full, "range long, slice long, shorts array<int>, checks array<long>, docs array<long>")
    )
    answers = sent.groupBy("range").applyInArrow(
        earlier_elsewhere, "slice long, range long, shorts array<int>, told array<boolean>"
    )
    answers = through_table(answers, "window-answers")
    schema = f"id {kind}, n_words long, spans array<struct<start: long, length: long>>, kept string"
    removed = stored.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(remove, schema)
    return removed.withColumnRenamed("id", id_col)
