"""Secret scans with a ledger of scanned blobs, so that no content is scanned twice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.llm.shared import broadcast_if_small, text_or_empty
from tidemark.sources.workspace import through_table

_SPANS = "array<struct<start:int,kind:int,end:int>>"
#: A repeated blob is 32 bytes and an id; so many are at most some 60 MB when broadcast.
MOST_BROADCAST_BLOBS = 500_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost without overlap; matches whose ``group`` has fewer than
    ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int
    least: int


# The base patterns, in the order in which kinds are listed.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    # A run is maximal either way, so the least length may stand in the pattern.
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
BASE_VERSION = "base-1"


def spans_of(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Sorted array of (start, kind number, end), in code points, end exclusive.

    Spark tells what matched and what lies between, not where; the places are the running
    sums of both lengths.
    """
    found = [F.when(text.rlike(r.pattern), _places(text, r, k)).otherwise(F.array().cast(_SPANS)) for k, r in enumerate(rules)]
    return F.array_sort(F.concat(*found))


def _places(text: Column, rule: Rule, kind: int) -> Column:
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    steps = F.transform(gaps, lambda g, i: F.struct(F.length(g).alias("gap"), F.get(hits, i).alias("hit")))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        held = x["hit"] if rule.group == 0 else F.regexp_extract(x["hit"], rule.pattern, rule.group)
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        good = x["hit"].isNotNull() & (F.length(held) >= rule.least)
        return F.struct(
            end.alias("at"),
            F.when(good, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))
    return F.aggregate(steps, begin, step, lambda state: state["spans"])


def scan_secrets(
    docs: DataFrame,
    ledger: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = BASE_RULES,
    rule_version: str = BASE_VERSION,
) -> DataFrame:
    """Findings of every row (path or historical version), scanning each blob once.

    A blob is the SHA-256 of the text. The ledger, a Parquet folder, has a row for each pair
    of blob and rule version that was scanned, with the spans found; a call scans only pairs
    that it lacks, one row for each blob, and joins the ledger back to all rows. Change
    ``rule_version`` whenever ``rules`` change.

    Returns ``id_col``, ``blob`` (binary) and ``spans`` (start, kind number, end; sorted; end
    exclusive, in code points) per input row. A null text counts as empty. Repeated rows and
    null ids each get their row. An empty table gives no rows and writes an empty ledger entry;
    other columns are not looked at.
    """
    spark = docs.sparkSession
    hashed = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).withColumn(
        "_blob", F.unhex(F.sha2("_text", 256))
    )
    versions = through_table(hashed.select("_id", "_blob"), "secret-versions")

    blobs = versions.groupBy("_blob").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    known = _entries(spark, ledger, rule_version)
    if known is None:
        special = blobs.where("_n > 1").select("_blob", "_first", F.lit(False).alias("_seen"))
    else:
        seen = known.select("_blob").distinct().withColumn("_hit", F.lit(True))
        special = blobs.join(seen, "_blob", "left").select(
            "_blob", "_first", F.col("_hit").isNotNull().alias("_seen"), "_n"
        ).where("_n > 1 OR _seen").drop("_n")
    special, _ = broadcast_if_small(through_table(special, "secret-blobs"), MOST_BROADCAST_BLOBS)
    unseen = hashed.join(special, "_blob", "left").where(
        F.col("_seen").isNull() | (~F.col("_seen") & F.col("_id").eqNullSafe(F.col("_first")))
    )
    unseen.select(
        "_blob", spans_of(F.col("_text"), rules).alias("_spans"), F.lit(rule_version).alias("rule_version")
    ).write.mode("append").partitionBy("rule_version").parquet(ledger)

    # A blob may have several entries (a row that repeats its id); they hold the same spans.
    found = _entries(spark, ledger, rule_version)
    if found is None:
        found = spark.createDataFrame([], f"_blob binary, _spans {_SPANS}")
    found = found.where(F.size("_spans") > 0).groupBy("_blob").agg(F.max("_spans").alias("_spans"))
    found = through_table(found, "secret-findings")
    return versions.join(found, "_blob", "left").select(
        F.col("_id").alias(id_col),
        F.col("_blob").alias("blob"),
        F.coalesce("_spans", F.array().cast(_SPANS)).alias("spans"),
    )


def _entries(spark, ledger: str, rule_version: str) -> DataFrame | None:
    """The ledger's rows of this version; None if there are none yet."""
    try:
        table = spark.read.schema(f"_blob binary, _spans {_SPANS}, rule_version string").parquet(ledger)
    except AnalysisException:  # no such folder
        return None
    return table.where(F.col("rule_version") == rule_version).drop("rule_version")
