"""Words of many texts at once, for use inside tasks."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Texts are worked on in slices of about so many bytes, which bounds a task's memory
#: whatever the batch size; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` whose text column has about ``most`` bytes each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-2))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)
    hand_back()


def hand_back() -> None:
    """Return freed memory to the machine: Spark keeps idle workers, and they would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work``, after which the worker, once all that it held is freed, hands its memory back."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        gc.collect()
        hand_back()

    return run


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words, the distinct words, and where each text's codes begin (n + 1).

    Words are runs of anything but blank, tab, line feed, vertical tab, form feed and return.
    Only A-Z are folded. A null text has no words.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # white space at an end of a text gives an empty word
        before = np.concatenate(([0], np.cumsum(full)))
        offsets, flat = before[offsets], flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, offsets


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


#: Of words of up to so many bytes each byte is looked up by its place.
_SHORT = 64
_BYTES = mixed(np.arange(1, 256 * _SHORT + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def summed_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word's bytes without a call for each word: a number for each byte at
    each place, added up and mixed. The few words above ``_SHORT`` bytes are hashed one by one."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    short = lengths <= _SHORT
    out = np.empty(len(words), np.uint64)
    if not short.all():
        out[~short] = hashes(words.filter(pa.array(~short)))
        words, lengths = words.filter(pa.array(short)), lengths[short]
    if len(words):
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary())), b"")
        data = np.frombuffer(joined[0].as_buffer(), np.uint8)
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(data)) - np.repeat(starts, lengths)
        sums = np.zeros(len(words), np.uint64)
        full = lengths > 0
        sums[full] = np.add.reduceat(_BYTES[(place << 8) + data], starts[full])
        out[short] = mixed(sums + lengths.astype(np.uint64))
    return out


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit hashes, the number of each key among them, and a place of each.

    As ``np.unique``, but plain numbers are sorted: a hash's upper bits with its place below. Only
    if hashes differ in no more than the lower bits are they sorted whole.
    """
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).view(np.int64)
    ordered = keys[order]
    if (ordered[1:] < ordered[:-1]).any():
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return ordered[new], number, order[new]


def list_column(values: np.ndarray, width: int) -> pa.Array:
    """Array column of ``width`` values a row from a flat or two-dimensional array."""
    flat = np.ascontiguousarray(values).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat))
