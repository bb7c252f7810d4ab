"""Alignment of two tokenizers' tokens by pointer jumping over overlapping byte ranges."""

from __future__ import annotations

import json
import math
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm import words
from tidemark.llm.slices import SLICES_PER_TASK, STORED_BYTES, text_bytes
from tidemark.sources.workspace import through_buckets, through_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Units go to the tokenizers in lots of about so many bytes; a longer unit is a lot of its own.
LOT_BYTES = 1 << 14
#: A group with more pairs of tokens is counted by its distinct ids.
PLAIN_PAIRS = 256
#: Rows leave the last pass in batches of about so many units.
PART_UNITS = 1 << 17

_CUT = re.compile(r"(?<=\S) (?=\S)")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_level_bytes() -> dict[str, int]:
    """Bytes by their characters in a byte-level vocabulary: printable ones stand for
    themselves, the others follow each other from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Bytes:
    """The bytes of each id of a tokenizer, and the id in digits."""

    def __init__(self, table: list[bytes]):
        self.table = table
        self.length = np.fromiter(map(len, table), np.int64, len(table))
        self.digits = np.arange(len(table)).astype(f"S{len(str(len(table) - 1))}")

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))


class Encoders:
    """Both tokenizers, and the bytes of each of their ids.

    ``cuttable`` says that both treat a text in units: neither has a token that goes on across a
    single blank between other characters, so units can be encoded once each.
    """

    def __init__(self, spec: str, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(spec)
        self.first.encode_special_tokens = True
        chars = byte_level_bytes()
        vocabulary = self.first.get_vocab(with_added_tokens=True)
        self.first_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.first_bytes[i] = bytes(chars.get(c, 0) for c in token)
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.vocab_size())]
        self.second_bytes = [
            bytes([int(_BYTE_PIECE.fullmatch(p)[1], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.tables = [Bytes(self.first_bytes), Bytes(self.second_bytes)]
        split = json.loads(spec).get("pre_tokenizer") or {}
        form = sentencepiece_model_pb2.ModelProto.FromString(model).normalizer_spec
        self.cuttable = (
            split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
            and not json.loads(spec).get("normalizer")
            and form.name == "identity"
            and form.add_dummy_prefix
            and not form.remove_extra_whitespaces
            and not any("▁" in p.lstrip("▁") for p in pieces)
        )

    def units(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuttable else [text]

    def alone(self, units: list[str]) -> np.ndarray:
        """Which units' ids are not the same behind and before other units."""
        if not self.cuttable:
            return np.ones(len(units), bool)
        return np.fromiter((u.strip() != u or "▁" in u for u in units), bool, len(units))

    def encode(self, text: str) -> list[np.ndarray]:
        """Ids of a text after a blank, by the first and by the second tokenizer."""
        [first] = self.first.encode_batch_fast([" " + text], add_special_tokens=False)
        return [np.array(ids, np.int32) for ids in (first.ids, self.second.encode(text))]


def linked_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each token of both sides, given where the tokens end in the same bytes.

    Every token points to the token overlapping it that reaches farthest right; of two that end
    together, to the second tokenizer's. Successors are doubled until nothing moves: then each
    token points at the last token of its component, which labels the group.
    """
    n = len(ends_a)
    onto_b = np.searchsorted(ends_b, ends_a)  # holds the token's last byte
    onto_a = np.searchsorted(ends_a, ends_b)
    beyond = ends_a[onto_a] > ends_b if n else np.zeros(len(ends_b), bool)
    own = n + np.arange(len(ends_b))
    kind = np.int32 if n + len(ends_b) < 1 << 31 else np.int64
    pointer = np.concatenate((n + onto_b, np.where(beyond, onto_a, own))).astype(kind)
    while True:
        farther = pointer[pointer]
        if np.array_equal(farther, pointer):
            break
        pointer = farther
    last = pointer[n:] == own
    label = (np.cumsum(last, dtype=kind) - 1)[pointer - n] if len(own) else pointer
    return label[:n], label[n:]


@dataclass
class Units:
    """What the distinct units of a slice hold: tokens, groups, links and the groups' text.

    Unit u's distinct id pairs are ``pair[pairs_from[u] : pairs_from[u + 1]]``, each ``times``
    times; a pair is first id * ``width`` + second id.
    """

    valid: np.ndarray
    tokens_a: np.ndarray
    tokens_b: np.ndarray
    groups: np.ndarray
    links: np.ndarray
    texts: list[bytes]
    pairs_from: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _lots(units: list[str], encoders: Encoders) -> Iterator[list[str]]:
    """Runs of units that can be encoded together; all others by themselves."""
    alone = encoders.alone(units)
    upto = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)) + 1)
    cut = np.diff(upto // LOT_BYTES, prepend=-1) > 0
    cut |= alone
    cut[1:] |= alone[:-1]
    starts = np.flatnonzero(cut).tolist()
    for x, y in zip(starts, [*starts[1:], len(units)]):
        yield units[x:y]


def _encoded(units: list[str], encoders: Encoders) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For either tokenizer the ids, each unit's number of ids, and whether they restore it."""
    found: list[list[tuple]] = [[], []]
    for lot in _lots(units, encoders):
        text = " ".join(lot)
        whole = _bytes(" " + text)
        if len(whole) == len(text) + 1:  # a byte a character
            ends = np.cumsum(np.fromiter(map(len, lot), np.int64, len(lot)) + 1)
        else:
            ends = np.cumsum(np.fromiter((len(_bytes(u)) for u in lot), np.int64, len(lot)) + 1)
        for side, (ids, table) in enumerate(zip(encoders.encode(text), encoders.tables)):
            upto = np.cumsum(table.length[ids])
            at = np.searchsorted(upto, ends)
            good = len(upto) > 0 and upto[-1] == ends[-1] and (upto[at] == ends).all() and table.joined(ids) == whole
            if good:
                found[side].append((ids, np.diff(at, prepend=-1), np.ones(len(lot), bool)))
            elif len(lot) == 1:
                found[side].append((ids, np.array([len(ids)]), np.zeros(1, bool)))
            else:
                raise ValueError("a tokenizer looks across the blanks between units")
    nothing = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool))]
    return [tuple(map(np.concatenate, zip(*(side or nothing)))) for side in found]


def _expanded(a, b, p, q, from_a, from_b) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, first id, second id, times) for all groups of p first and q second tokens."""
    plain = np.flatnonzero(p * q <= PLAIN_PAIRS)
    sizes = (p * q)[plain]
    upto = np.cumsum(sizes)
    at = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - sizes, sizes)
    wide = np.repeat(q[plain], sizes)
    parts = [
        (
            np.repeat(plain, sizes),
            a[np.repeat(from_a[plain], sizes) + at // wide],
            b[np.repeat(from_b[plain], sizes) + at % wide],
            np.ones(len(at), np.int64),
        )
    ]
    for g in np.flatnonzero(p * q > PLAIN_PAIRS):
        ids_a, n_a = np.unique(a[from_a[g] : from_a[g] + p[g]], return_counts=True)
        ids_b, n_b = np.unique(b[from_b[g] : from_b[g] + q[g]], return_counts=True)
        parts.append(
            (
                np.full(len(ids_a) * len(ids_b), g),
                np.repeat(ids_a, len(ids_b)),
                np.tile(ids_b, len(ids_a)),
                np.outer(n_a, n_b).ravel(),
            )
        )
    return tuple(np.concatenate(column) for column in zip(*parts))


def _texts(ids, labels, sizes, groups_of: np.ndarray, tables: list[Bytes]) -> list[bytes]:
    """`a,a|b;a|b,b` of each unit, from fixed-width texts of ids and the mark after each."""
    p, q = sizes
    wide = max(t.digits.itemsize for t in tables)
    cells = np.zeros((len(ids[0]) + len(ids[1]), wide + 1), np.uint8)
    before = np.concatenate(([0], np.cumsum(q)))[labels[0]], np.cumsum(p)[labels[1]]
    for own, table, other in zip(ids, tables, before):
        cells[np.arange(len(own)) + other, : table.digits.itemsize] = (
            table.digits[own].view(np.uint8).reshape(len(own), table.digits.itemsize)
        )
    cells[:, wide] = ord(",")
    group_end = np.cumsum(p + q)
    cells[group_end - q - 1, wide] = ord("|")
    cells[group_end - 1, wide] = ord(";")
    filled = cells != 0
    size = np.concatenate(([0], np.cumsum(filled.sum(axis=1))))
    joined = cells[filled].tobytes()
    unit_end = np.concatenate(([0], np.cumsum(groups_of)))
    ends = size[np.concatenate(([0], group_end))][unit_end].tolist()
    return [joined[x : max(x, y - 1)] for x, y in zip(ends[:-1], ends[1:])]


def describe_units(units: list[str], encoders: Encoders) -> Units:
    (a, sizes_a, good_a), (b, sizes_b, good_b) = _encoded(units, encoders)
    valid = good_a & good_b
    if not valid.all():
        a, b = a[np.repeat(valid, sizes_a)], b[np.repeat(valid, sizes_b)]
        sizes_a, sizes_b = np.where(valid, sizes_a, 0), np.where(valid, sizes_b, 0)
    label_a, label_b = linked_groups(*(np.cumsum(t.length[ids]) for t, ids in zip(encoders.tables, (a, b))))
    n = int(label_b[-1]) + 1 if len(label_b) else 0
    p, q = np.bincount(label_a, minlength=n), np.bincount(label_b, minlength=n)
    from_a, from_b = np.cumsum(p) - p, np.cumsum(q) - q
    unit = np.repeat(np.arange(len(units)), sizes_a)[from_a] if n else np.zeros(0, np.int64)
    groups = np.bincount(unit, minlength=len(units))
    upto = np.concatenate(([0], np.cumsum(p * q)))
    links = np.diff(upto[np.concatenate(([0], np.cumsum(groups)))])
    texts = _texts((a, b), (label_a, label_b), (p, q), groups, encoders.tables)
    del label_a, label_b
    g, x, y, times = _expanded(a, b, p, q, from_a, from_b)
    width = len(encoders.second_bytes)
    cells = np.int64(len(encoders.first_bytes) * width)
    named = unit[g] * cells + x.astype(np.int64) * width + y
    del a, b, g, x, y
    order = np.argsort(named, kind="stable")
    named = named[order]
    first = np.flatnonzero(np.diff(named, prepend=-1))
    times = np.add.reduceat(times[order], first) if len(first) else times
    of, pair = named[first] // cells, named[first] % cells
    return Units(
        valid, sizes_a, sizes_b, groups, links, texts,
        np.searchsorted(of, np.arange(len(units) + 1)), pair, times,
    )


class _Numbers(dict):
    """Numbers of distinct units in order of appearance."""

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        return number


def _sums(values: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each text's values, given by unit."""
    return np.diff(np.concatenate(([0], np.cumsum(values[codes])))[offsets])


def _spread(starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of the chosen rows of a list column, and how many each has."""
    sizes = (starts[1:] - starts[:-1])[chosen]
    upto = np.cumsum(sizes)
    return np.repeat(starts[chosen] - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0), sizes


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values, np.int32).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * count, codec="zstd", asbytes=True) if count else b"", np.int32)


def align_tokenizers(
    docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Groups of tokens of two tokenizers that cover the same bytes, and how common their links are.

    ``first`` is the path of a byte-level tokenizer file, ``second`` of a piece model, on the
    driver; their contents are broadcast (vocabularies, some megabytes). The first encodes a
    blank and the text, the second, which adds a blank, the text; strings of special tokens are
    plain text. Tokens overlap when their byte ranges do. Every token points to the farthest
    right one that overlaps it, and doubling successors labels the groups, which end where
    tokens of both end. All pairs of a group's tokens are links; an id pair counts the
    documents that hold it linked.

    Neither tokenizer looks across a single blank between other characters (checked; otherwise
    whole texts are the units), so each task encodes the distinct units of a slice of text once.
    A slice is stored as unit numbers with its units' groups and pairs, in buckets; texts and
    slices are never shuffled. Pairs are counted by Spark, combined before the shuffle, and each
    slice gets back the counts of its own pairs.

    Returns per input row ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``
    (links whose count is the highest of their first id, ties included), ``count_sum`` (counts
    added over links) and ``groups`` (ids as `a1,a2|b1;a3|b2`). Null and empty texts, and texts
    that either tokenizer does not restore, have zeros and an empty ``groups``. Repeated rows
    count as documents of their own; null ids are kept. A text longer than a slice is one of its
    own; a group's pairs are counted by distinct ids, which a task holds. An empty table gives
    no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    with open(first, encoding="utf-8") as spec, open(second, "rb") as model:
        files = spark.sparkContext.broadcast((spec.read(), model.read()))
    kind = docs.schema[id_col].dataType.simpleString()
    width = Encoders(*files.value).second.vocab_size()
    per_row = ["n_a", "n_b", "n_groups", "n_links"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoders, number = Encoders(*files.value), TaskContext.get().partitionId() * SLICES_PER_TASK
        for batch in batches:
            for part in words.slices(batch, 1, STORED_BYTES):
                numbers, codes, sizes = _Numbers(), [], []
                for text in part.column(1).to_pylist():
                    units = encoders.units(text) if text else []
                    codes.append(np.fromiter(map(numbers.__getitem__, units), np.int32, len(units)))
                    sizes.append(len(units))
                codes, sizes = np.concatenate(codes), np.array(sizes)
                units = describe_units(list(numbers), encoders)
                # A text with a unit that is not restored has no tokens.
                text_of = np.repeat(np.arange(len(sizes)), sizes)
                lost = np.bincount(text_of[~units.valid[codes]], minlength=len(sizes)) > 0
                codes, sizes = codes[~lost[text_of]], np.where(lost, 0, sizes)
                offsets = np.concatenate(([0], np.cumsum(sizes)))
                seen = np.unique(np.repeat(np.arange(len(sizes)), sizes) * np.int64(len(numbers)) + codes)
                at, each = _spread(units.pairs_from, seen % max(len(numbers), 1))
                cells = np.int64(len(encoders.first_bytes) * width)
                once = np.unique(np.repeat(seen // max(len(numbers), 1), each) * cells + units.pair[at])
                pairs, documents = np.unique(once % cells, return_counts=True)
                held = [_sums(v, codes, offsets) for v in (units.tokens_a, units.tokens_b, units.groups, units.links)]
                # Units of lost texts only may have pairs that no text holds: they point at 0 and are never used.
                places = np.minimum(np.searchsorted(pairs, units.pair), max(len(pairs) - 1, 0))
                number += 1
                row = {
                    "slice": pa.array([number - 1], pa.int64()),
                    "ids": pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)),
                    **{name: words.list_column(v.astype(np.int64), part.num_rows) for name, v in zip(per_row, held)},
                    "sizes": words.list_column(sizes.astype(np.int64), part.num_rows),
                    "codes": pa.array([_packed(codes)]),
                    "texts": pa.ListArray.from_arrays(pa.array([0, len(numbers)], pa.int32()), pa.array(units.texts, pa.binary())),
                    "pair_at": pa.array([_packed(places)]),
                    "pair_sizes": pa.array([_packed(np.diff(units.pairs_from))]),
                    "times": pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), pa.array(units.times)),
                    "pairs": pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(pairs)),
                    "documents": pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(documents)),
                }
                del numbers, codes, units, text_of, seen, at, each, once, places
                batch_out = pa.RecordBatch.from_arrays(list(row.values()), list(row))
                del row, pairs, documents, held, lost, offsets, sizes
                words.hand_back()
                yield batch_out

    schema = f"slice long, ids array<{kind}>, " + ", ".join(f"{c} array<long>" for c in [*per_row, "sizes"])
    schema += ", codes binary, texts array<binary>, pair_at binary, pair_sizes binary, times array<long>"
    schema += ", pairs array<long>, documents array<long>"
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = math.ceil(text_bytes(docs, text_col) / STORED_BYTES)
    stored = through_buckets(base.mapInArrow(words.tidied(describe), schema), "aligned", "slice", buckets)

    held = stored.select("slice", F.explode(F.arrays_zip("pairs", "documents")).alias("p"))
    held = held.select(F.col("slice").alias("of"), F.col("p.pairs").alias("pair"), F.col("p.documents").alias("n"))
    totals = through_table(held.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    # An id of the first tokenizer has at most as many pairs as the second has ids.
    of_first = Window.partitionBy(F.floor(F.col("pair") / width))
    told = totals.select("pair", "count", (F.col("count") == F.max("count").over(of_first)).alias("best"))
    answers = held.select("of", "pair").join(told, "pair")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        right = right.sort_by("pair")
        counts, best = right.column("count").to_numpy(), right.column("best").to_numpy().astype(np.int64)
        for row in left.to_batches():
            take = lambda name, r: row.column(name).slice(r, 1).flatten().to_numpy(zero_copy_only=False)
            for r in range(row.num_rows):
                sizes, times = take("sizes", r), take("times", r)
                texts = row.column("texts").slice(r, 1).flatten().to_pylist()
                codes = _unpacked(row.column("codes")[r].as_py(), int(sizes.sum()))
                places = _unpacked(row.column("pair_at")[r].as_py(), len(times))
                starts = np.concatenate(([0], np.cumsum(_unpacked(row.column("pair_sizes")[r].as_py(), len(texts)))))
                offsets = np.concatenate(([0], np.cumsum(sizes)))
                by_unit = lambda v: np.diff(np.concatenate(([0], np.cumsum(v[places] * times)))[starts])
                found = [_sums(by_unit(v), codes, offsets) if len(v) else np.zeros(len(sizes), np.int64) for v in (best, counts)]
                columns = {"id": row.column("ids").slice(r, 1).flatten(), **{c: pa.array(take(c, r)) for c in per_row}}
                told = pa.table({**columns, "n_best": pa.array(found[0]), "count_sum": pa.array(found[1])})
                parts = np.unique([0, *np.searchsorted(offsets, np.arange(PART_UNITS, offsets[-1], PART_UNITS))])
                for x, y in zip(parts, [*parts[1:], len(sizes)]):  # the groups' text is several times a slice
                    each = [texts[c] for c in codes[offsets[x] : offsets[y]].tolist()]
                    ends = (offsets[x : y + 1] - offsets[x]).tolist()
                    joined = pa.array([b";".join(each[i:j]) for i, j in zip(ends[:-1], ends[1:])], pa.binary())
                    out.append(told.slice(x, y - x).append_column("groups", joined.view(pa.string())))
        words.hand_back()
        return pa.concat_tables(out)

    names = [*per_row, "n_best", "count_sum"]
    result = f"id {kind}, " + ", ".join(f"{c} long" for c in names) + ", groups string"
    wanted = stored.drop("pairs", "documents")
    counted = wanted.groupBy("slice").cogroup(answers.groupBy("of")).applyInArrow(count, result)
    return counted.withColumnRenamed("id", id_col)
