"""Near duplicates by b-bit MinHash, with every link confirmed on full shingle sets."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import words
from tidemark.llm.components import connected_components
from tidemark.llm.shared import broadcast_if_small
from tidemark.sources.workspace import through_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A bucket has three longs, an id one or, in a struct, a few; so many are at most some 40 MB
#: when broadcast.
MOST_BROADCAST_KEYS = 250_000
#: Slots in which shingles are counted, a power of two (4 MB of counts), and blocks that they are sent in.
SLOTS, BLOCKS = 1 << 20, 64


@dataclass(frozen=True)
class Sketch:
    """``bands`` of ``rows`` minima make candidates; each of ``minima`` keeps two bits.

    With 32 bands of 4, a pair at similarity 0.75 shares no band with probability 5e-6, and
    the estimate from 256 two-bit minima lies below ``least_estimate`` with about 1e-7.
    """

    bands: int = 32
    rows: int = 4
    shingle: int = 5
    percent: int = 75
    least_estimate: float = 0.575
    minima: int = 256
    seed: int = 20
    most_paired: int = 64

    @property
    def planes(self) -> int:
        return self.minima // 64

    @property
    def least_equal(self) -> int:
        """Equal two-bit minima at ``least_estimate``: those of different elements agree by
        chance one time in four, so the expected share is J + (1 - J) / 4."""
        j = self.least_estimate
        return int(np.floor(self.minima * (j + (1 - j) / 4)))


def shingle_sets(texts: pa.Array, sketch: Sketch) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    codes, distinct, offsets = words.split_words(texts, lower=True)
    h = words.hashes(distinct, sketch.seed)[codes] if len(codes) else np.zeros(0, np.uint64)
    k, n = sketch.shingle, len(h)
    odd = words.mixed(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    joint = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k):
        joint += h[i : i + len(joint)] * odd[i]
    joint = words.mixed(joint)
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= k:
            yield np.unique(joint[a : b - k + 1])
        elif b > a:  # fewer words: the whole sequence, told apart from shingles by its length
            whole = np.array([b - a], np.uint64)
            for x in h[a:b]:
                whole = words.mixed(whole * np.uint64(0x9E3779B97F4A7C15) + x)
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def _minima(values: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    least = np.full(len(scale), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(values), 2048):
        np.minimum(least, (scale[:, None] * values[None, a : a + 2048] + shift[:, None]).min(axis=1), out=least)
    return least


def sketches(docs: DataFrame, id_col: str, text_col: str, sketch: Sketch) -> DataFrame:
    """``id``, ``n`` (set size), ``h0`` and ``h1`` (128 bits of the set), ``bands`` (hashes,
    told apart by band) and the bit planes ``p0``, ``p1``, … of the low bits."""
    kind = docs.schema[id_col].dataType.simpleString()
    planes = [f"p{i}" for i in range(2 * sketch.planes)]
    schema = f"id {kind}, n long, h0 long, h1 long, bands array<long>, " + ", ".join(f"{p} long" for p in planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rng = np.random.default_rng(sketch.seed)
        scale = rng.integers(0, 1 << 63, sketch.minima, np.uint64) * np.uint64(2) + np.uint64(1)
        shift = rng.integers(0, 1 << 63, sketch.minima, np.uint64)
        for batch in batches:
            for part in words.slices(batch, 1):
                rows = part.num_rows
                least = np.zeros((rows, sketch.minima), np.uint64)
                sizes, keys = np.zeros(rows, np.int64), np.zeros((rows, 2), np.uint64)
                for i, values in enumerate(shingle_sets(part.column(1), sketch)):
                    sizes[i] = len(values)
                    if len(values):
                        least[i] = _minima(values, scale, shift)
                        digest = xxhash.xxh3_128_digest(values.tobytes(), sketch.seed)
                        keys[i] = np.frombuffer(digest, np.uint64)
                joint = np.tile(np.arange(1, sketch.bands + 1, dtype=np.uint64), (rows, 1))
                grouped = least[:, : sketch.bands * sketch.rows].reshape(rows, sketch.bands, sketch.rows)
                for j in range(sketch.rows):
                    joint = words.mixed(joint * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, j])
                bits = [
                    np.packbits((least >> np.uint64(at)).astype(np.uint8) & 1, axis=1).view(np.int64) for at in (33, 34)
                ]
                columns = [pa.array(sizes), pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64))]
                columns.append(words.list_column(joint.view(np.int64), sketch.bands))
                columns += [pa.array(np.ascontiguousarray(b[:, i])) for b in bits for i in range(sketch.planes)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *columns], ["id", "n", "h0", "h1", "bands", *planes]
                )

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(words.tidied(run), schema)


def _members(nodes: DataFrame) -> DataFrame:
    """``bucket`` and ``key`` of nodes that share a bucket, and the two hubs of the bucket, ``low``
    and ``high``: the nodes that share most buckets with most others. A text whose copies were
    each edited lies in more of their buckets than they do in each other's, and links to more."""
    entries = nodes.select("key", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    hint, _ = broadcast_if_small(through_table(buckets, "near-buckets"), MOST_BROADCAST_KEYS)
    members = through_table(entries.join(hint, "bucket"), "near-shared")
    weights = members.groupBy("key").agg(F.sum("members").alias("weight"))
    members = members.join(weights, "key").select("bucket", "key", F.struct("weight", "key").alias("rank"))
    members = through_table(members, "near-weighed")

    best = through_table(members.groupBy("bucket").agg(F.max("rank").alias("best")), "near-best")
    hint, _ = broadcast_if_small(best, MOST_BROADCAST_KEYS)
    others = members.join(hint, "bucket").where("rank < best")
    hubs = others.groupBy("bucket").agg(F.max("rank").alias("next"), F.first("best").alias("best"))
    hubs = hubs.select("bucket", F.least("best.key", "next.key").alias("low"), F.greatest("best.key", "next.key").alias("high"))
    hint, _ = broadcast_if_small(through_table(hubs, "near-hubs"), MOST_BROADCAST_KEYS)
    return through_table(members.join(hint, "bucket").select("bucket", "key", "low", "high"), "near-members")


def _equal_bits(left: str, right: str, sketch: Sketch) -> Column:
    """Number of two-bit minima on which both sides agree."""
    k = sketch.planes
    differ = [
        F.bit_count(
            F.col(f"{left}.p{i}").bitwiseXOR(F.col(f"{right}.p{i}")).bitwiseOR(
                F.col(f"{left}.p{i + k}").bitwiseXOR(F.col(f"{right}.p{i + k}"))
            )
        )
        for i in range(k)
    ]
    return F.lit(sketch.minima) - sum(differ[1:], differ[0])


def _may_link(left: str, right: str, sketch: Sketch) -> Column:
    """Bound by set sizes and estimate from the packed bits."""
    small, large = F.least(f"{left}.n", f"{right}.n"), F.greatest(f"{left}.n", f"{right}.n")
    return (small * 100 >= large * sketch.percent) & (_equal_bits(left, right, sketch) >= sketch.least_equal)


def _sets(keys: DataFrame, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, sketch: Sketch) -> DataFrame:
    """``key`` and ``shingles`` of some nodes, made again from their documents' texts."""
    wanted = nodes.join(keys, "key", "left_semi").select("key", "h0", "h1", F.col("first").alias("id"))
    wanted = through_table(wanted, "near-wanted")
    ids, _ = broadcast_if_small(wanted.select("id"), MOST_BROADCAST_KEYS)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in words.slices(batch, 1):
                found = list(shingle_sets(part.column(1), sketch))
                digests = b"".join(xxhash.xxh3_128_digest(v.tobytes(), sketch.seed) for v in found)
                h = np.frombuffer(digests, np.int64).reshape(-1, 2)
                h0, h1 = (pa.array(np.ascontiguousarray(h[:, i])) for i in range(2))
                ends = np.cumsum([0] + [len(v) for v in found]).astype(np.int32)
                flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), h0, h1, lists], ["id", "h0", "h1", "shingles"])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    base = base.where(F.col("id").isNull()).unionByName(base.join(ids, "id", "left_semi"))
    made = base.mapInArrow(words.tidied(run), f"id {kind}, h0 long, h1 long, shingles array<long>")
    # Rows that share a wanted id may have other sets, and several rows the same: one a key.
    made = made.join(wanted.select("key", "h0", "h1"), ["h0", "h1"]).select("key", "shingles")
    made = through_table(made, "near-sets")
    return through_table(made.groupBy("key").agg(F.first("shingles").alias("shingles")), "near-sets")


def _similar(left: str, right: str, sketch: Sketch) -> Column:
    """100 |A ∩ B| >= percent |A ∪ B|, with |A ∪ B| = |A| + |B| - |A ∩ B|."""
    common = F.size(F.array_intersect(F.col(left), F.col(right)))
    return common * (100 + sketch.percent) >= (F.size(left) + F.size(right)) * sketch.percent


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, sketch: Sketch) -> DataFrame:
    """The pairs (a, b) of a stored table that are links, by packed bits first and sets then."""
    planes = [f"p{i}" for i in range(2 * sketch.planes)]
    x, y = (nodes.select("key", "n", *planes).alias(name) for name in "xy")
    pairs = (
        pairs.join(x, F.col("a") == F.col("x.key"))
        .join(y, F.col("b") == F.col("y.key"))
        .where(_may_link("x", "y", sketch))
        .select("a", "b")
    )
    pairs = through_table(pairs, "near-pairs")
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    sets = _sets(keys, docs, nodes, id_col, text_col, sketch)
    return through_table(_linked(pairs, sets, sketch), "near-links")


def _linked(pairs: DataFrame, sets: DataFrame, sketch: Sketch) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    return (
        pairs.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("_b")), "b")
        .join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("_a")), "a")
        .where(_similar("_a", "_b", sketch))
        .select("a", "b")
    )


def _slot_counts(sets: DataFrame) -> np.ndarray:
    """How many of all ``shingles`` fall into each of ``SLOTS`` slots by their first bits.

    A task sends its counts by blocks of slots, which are added up there; the driver gets ``SLOTS``
    counts, whatever the size of the sets.
    """
    width = SLOTS // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            counts += np.bincount(_slots(batch.column(0).flatten().to_numpy()), minlength=SLOTS)
        for block, held in enumerate(counts.reshape(BLOCKS, width)):
            at = np.flatnonzero(held)
            if len(at):
                columns = ([block], [at.astype("<i4").tobytes()], [held[at].astype("<i8").tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "at", "counts"])

    def add(table: pa.Table) -> pa.Table:
        held = np.zeros(width, np.int64)
        for at, counts in zip(table.column("at").to_pylist(), table.column("counts").to_pylist()):
            held[np.frombuffer(at, "<i4")] += np.frombuffer(counts, "<i8")
        held = np.minimum(held, np.iinfo(np.int32).max).astype("<i4")
        return pa.table({"block": table.column("block")[:1].cast(pa.int32()), "counts": pa.array([held.tobytes()], pa.binary())})

    counted = sets.select("shingles").mapInArrow(count, "block long, at binary, counts binary")
    counted = counted.groupBy("block").applyInArrow(add, "block int, counts binary")
    counts = np.zeros((BLOCKS, width), np.int32)
    for block, held in counted.collect():
        counts[block] = np.frombuffer(held, "<i4")
    return counts.ravel()


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _rare(sets: DataFrame, sketch: Sketch) -> DataFrame:
    """``key``, ``root``, ``shingle`` and ``rest`` (shingles from this one on) where sets may first
    meet, in the order of the slots' counts and then of the hashes. Any order that all sets share
    loses no link; counts of slots are never less than those of their shingles, so a shingle that
    is alone in its slot is in no other set."""
    counts = sets.sparkSession.sparkContext.broadcast(_slot_counts(sets))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = [np.zeros(0, np.int64)], np.zeros(batch.num_rows, np.int64)
            rests = [np.zeros(0, np.int64)]
            lists = batch.column(2)
            for i in range(batch.num_rows):
                own = lists[i].values.to_numpy()
                times = counts.value[_slots(own)]
                order = np.lexsort((own, times))
                rest = len(own) - np.arange(len(own))
                first = (rest * 100 >= len(own) * sketch.percent) & (times[order] > 1)
                flat.append(own[order][first])
                rests.append(rest[first])
                sizes[i] = first.sum()
            row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            columns = [batch.column(0).take(row), batch.column(1).take(row)]
            columns += [pa.array(np.concatenate(flat)), pa.array(np.concatenate(rests))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "root", "shingle", "rest"])

    return sets.select("key", "root", "shingles").mapInArrow(rank, "key long, root long, shingle long, rest long")


def _across(
    left: DataFrame, card: DataFrame, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, sketch: Sketch
) -> DataFrame:
    """Links (a, b) between the ``left`` members (bucket, key, root) of open buckets.

    In a bucket of at most ``sketch.most_paired`` members all pairs across components are held
    against the packed bits. Members of larger buckets are joined by rare shingles instead: in the
    order from the rarest shingle to the commonest, what two sets share stands in either from their
    first common shingle on. So the first common shingle of a link lies where enough shingles follow
    in both, which for sets of equal size is among the first n - ceil(2 t n / (1 + t)) + 1 (a seventh
    of a set at t = 0.75). Only members that share such a shingle there meet, however many lie in the
    bucket. That loses no link, and texts that have only a common passage in common do not meet by
    it. Sets are looked at for the pairs that are left.
    """
    sets = _sets(left.select("key").distinct(), docs, nodes, id_col, text_col, sketch)
    sizes = left.groupBy("bucket").agg(F.count("*").alias("members"))
    sized = through_table(left.join(sizes, "bucket"), "near-sized")
    few = sized.where(F.col("members") <= sketch.most_paired).select("bucket", "key", "root")
    many = sized.where(F.col("members") > sketch.most_paired).select("key", "root").distinct()
    t = sketch.percent

    # Small buckets.
    full = few.join(card, "key")
    x, y = full.alias("x"), full.alias("y")
    apart = (F.col("x.root") != F.col("y.root")) & _may_link("x", "y", sketch)
    same = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.key") < F.col("y.key")) & apart
    pairs = x.join(y, same).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    if many.isEmpty():
        return _linked(through_table(pairs.distinct(), "near-apart-pairs"), sets, sketch)

    # Large buckets. ``rest`` bounds what two sets share if they first meet here.
    rare = _rare(through_table(sets.join(many, "key"), "near-many"), sketch).join(card, "key")
    rare = through_table(rare, "near-rare")
    x, y = rare.where(F.col("rest") * (100 + t) >= F.col("n") * 2 * t).alias("x"), rare.alias("y")
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.key") < F.col("y.key")))
    enough = F.least("x.rest", "y.rest") * (100 + t) >= (F.col("x.n") + F.col("y.n")) * t
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & smaller & enough & apart)
    met = met.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))
    return _linked(through_table(pairs.unionByName(met).distinct(), "near-apart-pairs"), sets, sketch)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: Sketch = Sketch()
) -> DataFrame:
    """Components of documents whose shingle sets are similar (100 |A ∩ B| >= percent |A ∪ B|).

    A document's set are its distinct five-word shingles after folding A-Z; with fewer words,
    the whole sequence is one. Documents with equal sets are one node. In each bucket of a
    band all nodes are compared with two hubs, the nodes that share most buckets. Buckets whose other
    nodes are then still in several components are compared across components: small ones by
    pairs, larger ones by rare shingles that similar sets must share. Pairs are held against the packed bits first; every
    link is confirmed on full sets, which are made for candidates only.

    Returns per input row ``id_col``, ``n_shingles``, ``component_id`` (smallest id reachable)
    and ``kept`` (id = component_id). A null or blank text has an empty set and is linked with
    nothing. Rows that repeat an id share its decision; a row without id is in a component but
    is never its name unless no row has one. An empty table gives no rows; other columns are
    not looked at. A very long text is a slice of its own, and its set one row. Ids may be
    structs, which are compared field by field.
    """
    table = through_table(sketches(docs, id_col, text_col, sketch), "near-sketches")
    planes = [f"p{i}" for i in range(2 * sketch.planes)]
    nodes = (
        table.where("n > 0")
        .groupBy("h0", "h1")
        .agg(
            F.min("id").alias("first"), F.max("n").alias("n"), F.count("*").alias("rows"),
            F.first("bands").alias("bands"), *(F.max(p).alias(p) for p in planes),
        )
    )
    # The stored table gives each distinct set its number, by which it is known from here on.
    nodes = through_table(nodes.withColumn("key", F.monotonically_increasing_id()), "near-nodes")

    members = _members(nodes)
    card = nodes.select("key", "n", *planes)

    def stars(hub: str) -> DataFrame:
        return members.where(F.col("key") != F.col(hub)).select(F.least("key", hub).alias("a"), F.greatest("key", hub).alias("b"))

    stars = through_table(stars("low").unionByName(stars("high")).distinct(), "near-stars")
    links = _confirmed(stars, docs, nodes, id_col, text_col, sketch)
    roots = through_table(connected_components(links), "near-roots")

    # Nodes of a bucket that were compared with no other than its hubs, and stand apart still.
    rest = members.where("key <> low AND key <> high").select("bucket", "key")

    rooted = rest.join(roots, F.col("key") == F.col("node"), "left")
    rooted = through_table(rooted.select("bucket", "key", F.coalesce("root", "key").alias("root")), "near-rest")
    open_ = rooted.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1")
    hint, _ = broadcast_if_small(through_table(open_.select("bucket"), "near-open"), MOST_BROADCAST_KEYS)
    left = through_table(rooted.join(hint, "bucket"), "near-apart")

    more = through_table(_across(left, card, docs, nodes, id_col, text_col, sketch), "near-links")
    if not more.isEmpty():
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = through_table(connected_components(known.unionByName(more)), "near-roots")

    named = nodes.join(roots, F.col("key") == F.col("node"), "left").select(
        "key", "h0", "h1", "first", "rows", F.coalesce("root", "key").alias("root"), F.col("root").isNotNull().alias("linked")
    )
    named = through_table(named.where("linked OR rows > 1"), "near-named")
    names = through_table(named.groupBy("root").agg(F.min("first").alias("component_id")), "near-names")
    named = through_table(named.join(names, "root").select("h0", "h1", "component_id", F.lit(True).alias("known")), "near-named")
    plain = table.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    others = table.where("n > 0").join(named, ["h0", "h1"], "left").select(
        "id", "n", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )
    return plain.unionByName(others).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
