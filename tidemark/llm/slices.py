"""Texts stored in slices that later passes read again without a shuffle."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import words
from tidemark.sources.workspace import through_buckets

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Text of a slice in bytes; a longer text is a slice of its own.
STORED_BYTES = 8 << 20
#: A task numbers its slices from its partition times this.
SLICES_PER_TASK = 1 << 31


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0


def stored_slices(docs: DataFrame, id_col: str, text_col: str, total: int, most: int | None = None) -> DataFrame:
    """``slice``, ``id`` and ``text``, stored in buckets of ``slice``.

    A slice is a run of rows that one task read, ``most`` bytes of text or a single longer one.
    Rows belong to a slice by position, so neither hot ids nor null ids or repeated rows gather
    in one. ``total`` is the size of all texts.
    """
    most = most or STORED_BYTES
    kind = docs.schema[id_col].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * SLICES_PER_TASK
        held = 0
        for batch in batches:
            for part in words.slices(batch, 1, most):
                size = part.column(1).nbytes
                if held and held + size > most:  # small batches share a slice
                    number, held = number + 1, 0
                held += size
                names = pa.array([number], pa.int64()).take(pa.array([0] * part.num_rows))
                yield pa.RecordBatch.from_arrays([names, part.column(0), part.column(1)], ["slice", "id", "text"])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    dealt = base.mapInArrow(deal, f"slice long, id {kind}, text string")
    return through_buckets(dealt, "slices", "slice", math.ceil(total / most))
