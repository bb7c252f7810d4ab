"""Packing token sequences online by the sum of squares of fill levels."""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A task numbers its sequences from its partition times this.
SEQUENCES_PER_TASK = 1 << 33
#: Larger slices have fewer distinct words for their size, and take more memory.
SLICE_BYTES = 3 << 20
#: Ids in partially filled windows; beyond them a task lets the windows fill each other up.
MOST_HELD_IDS = 4 << 20
#: Windows in a batch of rows: some 400,000 ids.
BATCH_WINDOWS = 200


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all items of runs, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids of texts by a tokenizer that drops white space and splits words by ``pattern``.

    Each distinct word of a slice is looked at once. Words of plain characters are folded and
    split here, all at a time, as the tokenizer's file says. Their distinct parts, of which most
    were met before, go to the tokenizer's model; any other word goes through the whole tokenizer.
    """

    #: Parts whose ids are remembered (some 100 MB); then the memory is begun anew.
    MOST_PARTS = 500_000
    # The characters of which plain words are, what the tokenizer's own pattern takes
    # each of their folded bytes for (0, a letter or a digit), and the endings it takes for parts:
    # 's|'t|'re|'ve|'m|'ll|'d|letters|digit|others.
    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
    KINDS = np.array([1 if i >= 0x80 or chr(i).islower() else 2 * chr(i).isdigit() for i in range(256)], np.int8)
    ENDINGS = (1, (b"s", b"t", b"m", b"d")), (2, (b"re", b"ve", b"ll"))

    def __init__(self, spec: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # The tokenizer's spelling of each character outside ASCII that PLAIN allows.
        self.spelled = {i: byte_level.pre_tokenize_str(chr(i))[0][0] for i in range(0xC0, 0x100)}
        self.known: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        spelled = part if part.isascii() else part.translate(self.spelled)
        ids = array("i", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        if len(self.known) >= self.MOST_PARTS:
            self.known.clear()
        self.known[part] = ids
        return ids

    def _cut(self, plain: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The parts of plain words, folded, and how many each word has."""
        folded = pc.utf8_lower(plain).cast(pa.string())
        if not len(folded):
            return folded, np.zeros(0, np.int64)
        offsets = np.frombuffer(folded.buffers()[1], np.int32, len(folded) + 1, 4 * folded.offset)
        data = np.frombuffer(folded.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kinds, size = self.KINDS[data], len(data)
        begins = np.ones(size + 1, bool)
        begins[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)
        begins[offsets] = True

        # An apostrophe alone before letters: it and an ending are a part.
        mark = np.flatnonzero((data == ord("'")) & begins[:-1])
        for length, endings in self.ENDINGS:
            there = mark[mark + length < size]
            word = np.searchsorted(offsets, there, "right")
            there = there[there + length < offsets[word]]
            found = np.zeros(len(there), bool)
            for ending in endings:
                found |= np.all([data[there + 1 + i] == c for i, c in enumerate(ending)], axis=0)
            begins[there[found] + 1] = False
            begins[there[found] + 1 + length] = True

        cuts = np.flatnonzero(begins).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data))
        return parts, np.diff(np.searchsorted(cuts, offsets))

    def _word_ids(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and where in them those of each word begin and how many they are."""
        marked = pc.match_substring(distinct, "<|")
        plain = pc.and_not(pc.match_substring_regex(distinct, f"^{self.PLAIN.pattern}$"), marked)
        parts, counts = self._cut(distinct.filter(plain))
        parts, odd = parts.dictionary_encode(), distinct.filter(pc.invert(plain))

        held, known = [], self.known
        for part in parts.dictionary.to_numpy(zero_copy_only=False).tolist():
            ids = known.get(part)
            held.append(self._part(part) if ids is None else ids)
        for word in odd.to_pylist():
            held.append(array("i", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes())
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        starts = np.cumsum(sizes) - sizes

        # Plain words are runs of parts; the others stand after all parts, in their order.
        plain = plain.to_numpy(zero_copy_only=False)
        of_word = np.ones(len(distinct), np.int64)
        of_word[plain] = counts
        of_plain = np.repeat(plain, of_word)
        row = np.empty(len(of_plain), np.int64)
        row[of_plain] = parts.indices.to_numpy(zero_copy_only=False)
        row[~of_plain] = np.arange(len(held) - len(odd), len(held))
        flat = np.frombuffer(b"".join(held), np.int32)[_runs(starts[row], sizes[row])]
        ends = np.concatenate(([0], np.cumsum(sizes[row])))[np.concatenate(([0], np.cumsum(of_word)))]
        return flat, ends[:-1], np.diff(ends)

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """Ids of each text and then ``end_id``."""
        codes, distinct, offsets = words.split_words(texts)
        flat, starts, sizes = self._word_ids(distinct)
        ends = np.concatenate(([0], np.cumsum(sizes[codes])))[offsets]
        ids = np.full(ends[-1] + len(texts), end_id, np.int32)
        within = np.repeat(np.arange(len(texts)), np.diff(ends))  # one end stands before each further text
        ids[np.arange(ends[-1]) + within] = flat[_runs(starts[codes], sizes[codes])]
        ends += np.arange(len(ends))
        for a, b in zip(ends[:-1], ends[1:]):
            yield ids[a:b]


class Windows:
    """Partially filled windows by fill level, and where a rest of a document goes."""

    def __init__(self, window: int, first: int):
        self.window, self.next, self.held_ids = window, first, 0
        self.levels: list[list] = [[] for _ in range(window)]
        self.counts = np.zeros(window + 1, np.int64)

    def number(self) -> int:
        self.next += 1
        return self.next - 1

    def best_level(self, size: int) -> int:
        """Level (0: a new window) whose choice adds least to the sum of squared counts.

        Moving a window from level l to l + size changes the sum by 2 - 2 n(l) + 2 n(l + size);
        a window that becomes full no longer counts. Ties go to the fullest window.
        """
        counts, top = self.counts, self.window - size
        cost = 2 - 2 * counts[1 : top + 1] + 2 * counts[size + 1 : self.window + 1]
        if top:
            cost[-1] -= 1  # the full window is not counted: no 2 n + 1
            cost = np.where(counts[1 : top + 1] > 0, cost, np.iinfo(np.int64).max)
            best = top - 1 - int(np.argmin(cost[::-1]))
            if cost[best] <= 2 * counts[size] + 1:
                return best + 1
        return 0

    def place(self, piece: tuple) -> list | None:
        """Put a piece (its last item are the ids) somewhere; the pieces of a window it fills."""
        size = len(piece[-1])
        level = self.best_level(size)
        held = self.levels[level].pop() if level else []
        self.counts[level] -= bool(level)
        held.append(piece)
        self.held_ids += size
        if level + size == self.window:
            self.held_ids -= self.window
            return held
        self.levels[level + size].append(held)
        self.counts[level + size] += 1
        return None

    def close(self) -> Iterator[list]:
        """All windows left, filled up by cutting the emptiest; at most one stays partial."""
        left = [held for level in self.levels for held in level]  # emptiest first
        low = 0
        while left and low < len(left):
            held = left.pop()
            room = self.window - sum(len(p[-1]) for p in held)
            while room and low < len(left):
                key, start, total, ids = left[low].pop()
                if len(ids) > room:
                    left[low].append((key, start + room, total, ids[room:]))
                    ids = ids[:room]
                held.append((key, start, total, ids))
                room -= len(ids)
                if not left[low]:
                    low += 1
            yield held
        self.levels, self.counts[:], self.held_ids = [[] for _ in range(self.window)], 0, 0


def pack_sequences(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    end_id: int = 1,
) -> DataFrame:
    """Pieces of all documents, placed in sequences of ``window`` ids.

    ``tokenizer`` is the path of a tokenizer file on the driver; its content is broadcast (a
    vocabulary, some megabytes). A document is its ids and ``end_id``. Whole windows are cut
    from its front; the rest is placed online into the fill level that keeps the sum of the
    squared numbers of partially filled windows least. Each task packs the partition that it
    reads, so nothing is shuffled. At its end, and whenever ``MOST_HELD_IDS`` ids wait in
    partial windows, the windows left fill each other up; one partial window remains each time.

    Returns a row per piece: ``id_col``, ``start`` (ids of the document before it),
    ``length``, ``ids`` (binary, little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id`` and ``offset``. A null or empty text is ``end_id`` alone. Repeated rows and
    null ids are packed like others. An empty table gives no rows; other columns are not
    looked at. A task holds one slice of texts (or one very long text) and the waiting ids.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    id_field = docs.schema[id_col]
    schema = f"id {id_field.dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(spec.value)
        windows = Windows(window, TaskContext.get().partitionId() * SEQUENCES_PER_TASK)
        kind = None

        def rows(done: list[tuple[int, list]]) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(7)]
            for number, held in done:
                at = 0
                for key, start, total, ids in held:
                    for col, value in zip(cols, (key, start, len(ids), ids.astype("<u4").tobytes(), total, number, at)):
                        col.append(value)
                    at += len(ids)
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        def closed(windows: Windows) -> Iterator[pa.RecordBatch]:
            left = windows.close()
            while some := [(windows.number(), held) for held in islice(left, BATCH_WINDOWS)]:
                yield rows(some)

        for batch in batches:
            kind = batch.schema.field(0).type
            for part in words.slices(batch, 1, SLICE_BYTES):
                done = []
                for key, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1), end_id)):
                    total = len(ids)
                    whole = total - total % window
                    for start in range(0, whole, window):
                        done.append((windows.number(), [(key, start, total, ids[start : start + window])]))
                    if whole < total:
                        held = windows.place((key, whole, total, ids[whole:].copy()))
                        if held:
                            done.append((windows.number(), held))
                    if len(done) >= BATCH_WINDOWS:
                        yield rows(done)
                        done = []
                    if windows.held_ids > MOST_HELD_IDS:
                        yield from closed(windows)
                yield rows(done)
        if kind is not None:
            yield from closed(windows)

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(words.tidied(pack), schema).withColumnRenamed("id", id_col)
