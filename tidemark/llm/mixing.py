"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.shared import WORD, text_or_empty
from tidemark.sources.workspace import through_table

# The weights that sources get in turn, by code point, null last.
TURN_WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most_times: int) -> DataFrame:
    """Target of each source (``source``, ``source_size``): its weight's share of all sizes.

    No target exceeds ``most_times`` the source's size; what is above goes to the others by
    weight until none is above. That is one level L with target = min(cap, weight * L): in the
    order of cap / weight the sources before some place are capped, and L is what is left for
    the rest over their weight. One row per source meets in a window, never documents.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("weight", pick.cast("double"))
        .withColumn("_cap", F.col("source_size") * F.lit(float(most_times)))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_weights", F.sum("weight").over(everything))
        .withColumn("_caps_before", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weights_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_caps_before")) / (F.col("_weights") - F.col("_weights_before")))
    )
    # The first place whose cap is not reached sets the level of all from there on.
    level = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_level"))).over(everything)
    return ranked.withColumn("_open", level).select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("_open").isNull() | (F.col("_ratio") < F.col("_open._ratio")), F.col("_cap"))
        .otherwise(F.least("_cap", F.col("weight") * F.col("_open._level")))
        .alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = TURN_WEIGHTS,
    most_times: int = 3,
    seed: str = "mix",
    ranges: int = 1024,
    order_col: str | None = None,
) -> DataFrame:
    """Take whole documents, some up to ``most_times``, so that sources come near their targets.

    Documents of a source queue in the order of md5(seed, ``order_col``), the id unless another
    column is named; ties go by id. A copy's virtual finish time is
    its source's tokens up to its end over the source's target; the queue begins anew for
    second and third copies. All copies are then sorted by virtual finish time, in ``ranges``
    ranges of that time for each unit, and taken until the total budget, the sum of all sizes,
    is used up. Running sums go over ranges of hashes first and rows second, so a source with
    most of the rows is many windows, and only the range in which the budget ends is sorted
    row by row. Sizes are counted once and stored; texts are not shuffled.

    Returns ``id_col``, ``source_col``, ``size``, ``source_size``, ``target``, ``taken`` (words
    taken, repeats counted) and ``copies`` per input row. A null text has size 0; documents of
    size 0 have nothing to take and get 0 copies. A null source is a source of its own. Rows
    that repeat an id queue after each other; equal rows are interchangeable. An empty table
    gives no rows; other columns are not looked at.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(order_col or id_col).cast("string"), F.lit("")))
    sized = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.md5(key).alias("_order"),
    )
    # md5 orders the queue; its first five digits give the range.
    head = F.conv(F.substring("_order", 1, 5), 16, 10).cast("long")
    sized = sized.withColumn("_range", F.shiftright(head * ranges, 20).cast("int"))
    sized = through_table(sized, "mix-sizes")

    parts = through_table(
        sized.groupBy("source", "_range").agg(F.sum("size").alias("_part")), "mix-parts"
    )
    sizes = parts.groupBy("source").agg(F.sum("_part").alias("source_size"))
    sources = through_table(source_targets(sizes, weights, most_times), "mix-sources")
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_before", F.coalesce(F.sum("_part").over(before), F.lit(0)))
    starts = starts.join(sources, starts["source"].eqNullSafe(sources["source"])).select(
        starts["source"], "_range", "_before", "source_size", "target"
    )
    starts = through_table(starts, "mix-starts")

    inside = (
        Window.partitionBy("source", "_range")
        .orderBy("_order", "_id", "size")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    queued = sized.withColumn("_inside", F.sum("size").over(inside))
    same = queued["source"].eqNullSafe(starts["source"]) & (queued["_range"] == starts["_range"])
    queued = queued.join(starts, same).select(
        "_id", queued["source"], "size", "_order", "source_size", "target",
        (F.col("_before") + F.col("_inside")).alias("_end"),
    )
    queued = through_table(queued, "mix-queued")

    # Places of a document's copies in the global order. Times beyond the fourth unit share a
    # slot, which only matters if the budget ends there, and is then sorted as a whole.
    place = F.transform(
        F.sequence(F.lit(0), F.lit(most_times - 1)),
        lambda again: F.struct(
            ((F.col("_end") + again * F.col("source_size")) / F.col("target")).alias("time"),
            F.col("source").alias("source"),
            F.col("_order").alias("order"),
            F.col("_id").alias("id"),
            again.alias("again"),
        ),
    )
    placed = queued.withColumn("_places", F.when(F.col("size") > 0, place))
    copies = placed.where("size > 0").select("size", F.explode("_places").alias("_place"))
    slot = F.least(F.floor(F.col("_place.time") * ranges), F.lit(4 * ranges)).cast("long")
    copies = copies.withColumn("_slot", slot)
    slots = copies.groupBy("_slot").agg(F.sum("size").alias("_words"))
    upto = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = through_table(slots.withColumn("_upto", F.sum("_words").over(upto)), "mix-slots")
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    ends = slots.where(F.col("_upto") > budget).agg(F.min(F.struct("_slot", "_upto", "_words"))).first()[0]

    taken = F.size("_places")
    if ends is not None:
        row = Window.partitionBy("_slot").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
        edge = (
            copies.where(F.col("_slot") == ends["_slot"])
            .withColumn("_sum", F.sum("size").over(row) + (ends["_upto"] - ends["_words"]))
            .where(F.col("_sum") <= budget)
            .agg(F.max("_place").alias("_last"))
        )
        edge = through_table(edge, "mix-edge")
        last = edge.first()["_last"]
        place_slot = lambda x: F.least(F.floor(x["time"] * ranges), F.lit(4 * ranges)).cast("long")
        if last is None:
            within = lambda x: place_slot(x) < ends["_slot"]
        else:
            kinds = edge.schema["_last"].dataType
            cut = F.struct(*(F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in kinds.fields))
            within = lambda x: (place_slot(x) < ends["_slot"]) | (
                (place_slot(x) == ends["_slot"]) & (x <= cut)
            )
        taken = F.size(F.filter("_places", within))
    taken = F.when(F.col("size") > 0, taken).otherwise(0)
    return placed.select(
        F.col("_id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        (F.col("size") * taken).alias("taken"),
        taken.alias("copies"),
    )
