"""From raw documents to packed training sequences, in five written stages.

Every stage takes (spark, docs, sf_dir) and its result is stored before the next begins, so a
lost executor costs a stage at most and every table of decisions can be read again. ``docs``
needs the columns of documents, any of them null; others are left out. An empty table stays
empty in every stage, and very long texts are handled whole. Ids need not be unique: a decision
holds for its row alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.exact_dedup import exact_duplicates
from tidemark.llm.mixing import mix_sources
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import pack_sequences
from tidemark.llm.shared import broadcast_if_small
from tidemark.llm.toxicity import fit_toxicity, score_toxicity
from tidemark.sources.workspace import new_folder, through_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A row number is one long; so many are at most some 40 MB when broadcast.
MOST_BROADCAST_ROWS = 1_000_000
#: Rows of a batch between Spark and its Python workers. Texts have kilobytes each, so batches
#: of Spark's usual 10,000 rows would take tens of megabytes several times over in every task.
BATCH_ROWS = 1000


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs``, stored with a number ``_row`` for each row and a ``_key`` that orders rows as
    their ids do (rows without id last), so that decisions are taken and applied row by row."""
    kept = docs.select(COLUMNS).withColumn("_row", F.monotonically_increasing_id())
    path = new_folder(docs.sparkSession, "numbered")
    kept.write.option("compression", "zstd").parquet(path)
    kept = docs.sparkSession.read.schema(kept.schema).parquet(path)
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.col("_row").alias("row"))
    return kept.withColumn("_key", key)


def _without(docs: DataFrame, dropped: DataFrame, label: str) -> DataFrame:
    """Numbered ``docs`` without the rows whose numbers are in ``dropped``."""
    dropped, _ = broadcast_if_small(through_table(dropped, label), MOST_BROADCAST_ROWS)
    return docs.join(dropped, "_row", "left_anti").select(COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of all labels does not reject (score below 0.5).

    A null or empty text has the base score and stays. Rows that share an id are scored each.
    Without labels nothing is rejected.
    """
    docs = _numbered(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, fit_toxicity(docs, labels), id_col="_row")
    return _without(docs, scored.where("predicted = 1").select("_row"), "toxic-rows")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the smallest id.

    Null and empty texts are equal. Of rows that share the id, or have none, one stays.
    """
    docs = _numbered(docs)
    found = exact_duplicates(docs, id_col="_key")
    return _without(docs, found.where("NOT kept").select(F.col("_key.row").alias("_row")), "copied-rows")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, that with the smallest id.

    Texts without a word are linked with nothing and stay. Rows that share an id are judged
    each by their own text.
    """
    docs = _numbered(docs)
    found = near_duplicates(docs, id_col="_key")
    return _without(docs, found.where("NOT kept").select(F.col("_key.row").alias("_row")), "near-rows")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or several times.

    Texts without a word have nothing to take and go. Rows that share an id, or have none,
    queue after each other and are taken each as often as its own place says.
    """
    docs = _numbered(docs)
    taken = mix_sources(docs, id_col="_row", order_col="doc_id").select("_row", "copies")
    taken = through_table(taken, "mixed-rows")
    other, _ = broadcast_if_small(through_table(taken.where("copies <> 1"), "mixed-other"), MOST_BROADCAST_ROWS)
    counted = docs.join(other, "_row", "left").withColumn("_copies", F.coalesce("copies", F.lit(1)))
    again = F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")
    return counted.where("_copies > 0").select(*COLUMNS, again).drop("_copy")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 2048 ids; a null text is an empty one."""
    return pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The model and the tokenizer have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def _own_session(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings but for ``BATCH_ROWS``; the caller's stays as it is."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return own


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents, each written as Parquet and read again."""
    own = _own_session(spark)
    docs = own.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(own, f"pipeline-{name}")
        stage(own, docs, sf_dir).write.parquet(path)
        docs = own.read.parquet(path)
    return spark.read.parquet(path)
