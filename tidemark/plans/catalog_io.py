"""Source, sink and streaming queries: each writes whole tables and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.operators import datasets as ds
from tidemark.operators import documents
from tidemark.operators import statements as st
from tidemark.plans.catalog_text import CHUNKS_SQL, FOLD_SQL, SENTENCES_SQL
from tidemark.plans.catalog_datasets import (
    _INDEXED,
    _MARKET,
    _TALKS,
    json_lines,
    split_questions,
    talks,
)
from tidemark.plans.registry import query
from tidemark.sources import readers, writers
from tidemark.sources.workspace import new_folder, through_buckets, through_table
from tidemark.streaming import bars, ingest

FACT = "stock_code, category_code, year, quarter, data"
DATE_ADDED = "strftime(date_added, '%Y-%m-%d') AS date_added"


def typed_statement(t):
    """Statement rows with the stated schema of the statement table."""
    return writers.loadable(t.statement, schemas.STATEMENT)


def dated(df, column="date_added"):
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd"))


# -- sources ------------------------------------------------------------------------


@query("src1", f"SELECT {FACT}, segment, {DATE_ADDED} FROM statement WHERE year >= 1999", "statement")
def src1(t):
    """Parquet facts read with a stated schema; filter and columns reach the scan."""
    path = new_folder(t.spark, "src1")
    writers.to_parquet(typed_statement(t), path)
    return dated(readers.facts(t.spark, path, schemas.STATEMENT).where(F.col("year") >= 1999))


@query("src2", "SELECT p_partkey AS ratio_code, p_name AS ratio_name, p_brand AS function_name FROM part")
def src2(t):
    """CSV dimension with a padded column, trimmed on reading."""
    path = new_folder(t.spark, "src2")
    padded = t["part"].select(
        "p_partkey", "p_name", F.concat(F.lit("  "), "p_brand", F.lit(" ")).alias("function_name")
    )
    writers.to_csv(padded, path)
    dim = readers.dimension(t.spark, path, "ratio_code long, ratio_name string, function_name string", ["function_name"])
    return dim


@query(
    "src3",
    """SELECT count(*) FILTER (event_id % 6 NOT IN (0, 2)) AS kept, count(*) FILTER (event_id % 6 IN (0, 2)) AS skipped FROM events""",
)
def src3(t):
    """JSON lines with damage and blank lines: how many were kept and skipped."""
    path = new_folder(t.spark, "src3")
    lines = json_lines(t).unionByName(t["nation"].select(F.lit("").alias("value")))
    lines.write.text(path)
    loose = T.StructType([T.StructField(c, T.StringType()) for c in ("data_source", "prompt", "extra_info")])
    return readers.line_counts(readers.json_lines(t.spark, path, loose))


@query(
    "src4",
    """SELECT series_key, count(*) AS days, max(close) AS highest FROM bars
    WHERE time BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND series_key IN ('1-URGENT', '5-LOW') AND volume >= 2 GROUP BY 1""",
    "bars",
)
def src4(t):
    """SQL with named, typed parameters, one of them a list."""
    return readers.query(
        t.spark,
        """SELECT series_key, count(*) AS days, max(close) AS highest FROM {bars}
        WHERE time BETWEEN CAST(:start AS DATE) AND CAST(:end AS DATE) AND array_contains(:keys, series_key)
          AND volume >= :least GROUP BY series_key""",
        {"start": "1996-01-01", "end": "1998-12-31", "keys": F.array(F.lit("1-URGENT"), F.lit("5-LOW")), "least": 2},
        bars=t.bars,
    )


@query(
    "src5",
    "SELECT n_name AS entity, c_custkey, c_acctbal + 1 AS c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def src5(t):
    """Newest file of each nation; an older one is left aside."""
    path = new_folder(t.spark, "src5")
    rows = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_name", "c_custkey", "c_acctbal"
    )
    rows.write.partitionBy("n_name").parquet(f"{path}/a")
    newer = rows.withColumn("c_acctbal", F.col("c_acctbal") + 1)
    newer.repartition("n_name").write.partitionBy("n_name").parquet(f"{path}/b")
    found = readers.latest_files(
        t.spark, f"{path}/*/*", "c_custkey long, c_acctbal double", r"n_name=([^/]+)/"
    )
    return found.withColumn("entity", F.regexp_replace("entity", "%20", " "))


@query(
    "src6",
    "SELECT conv_id, CAST(n AS INTEGER) AS messages, first_role FROM talks",
    extra={"talks": _TALKS},
)
def src6(t):
    """Nested message lists written as JSON and read with a stated schema."""
    path = new_folder(t.spark, "src6")
    talks(t).select("conv_id", "prompt").write.json(path)
    schema = T.StructType(
        [T.StructField("conv_id", T.LongType()), T.StructField("prompt", T.ArrayType(schemas.MESSAGE))]
    )
    rows = readers.messages(t.spark, path, schema)
    return rows.select("conv_id", F.size("prompt").alias("messages"), F.col("prompt")[0]["role"].alias("first_role"))


# -- sinks -----------------------------------------------------------------------------


@query("snk1", f"SELECT {FACT}, segment, {DATE_ADDED} FROM statement", "statement")
def snk1(t):
    """Parquet write."""
    path = new_folder(t.spark, "snk1")
    writers.to_parquet(typed_statement(t), path)
    return dated(readers.facts(t.spark, path, schemas.STATEMENT))


@query("snk2", f"SELECT {FACT} FROM statement", "statement")
def snk2(t):
    """CSV write with a header."""
    path = new_folder(t.spark, "snk2")
    writers.to_csv(t.statement.select(*FACT.split(", ")), path)
    schema = "stock_code string, category_code string, year int, quarter int, data double"
    return readers.dimension(t.spark, path, schema)


@query(
    "snk3",
    """SELECT series_key AS index_name, strftime(time, '%Y-%m-%d') AS time, close, volume FROM bars WHERE volume > 1
    UNION ALL SELECT series_key, strftime(time, '%Y-%m-%d'), close, volume FROM bars WHERE volume > 1""",
    "bars",
)
def snk3(t):
    """Two appends to a table; rows without the required close are dropped."""
    path = new_folder(t.spark, "snk3")
    schema = T.StructType([f for f in schemas.series("index_name", ()).fields])
    rows = t.bars.select(
        "time",
        F.when(F.col("volume") > 1, F.col("close")).alias("close"),
        "volume",
        F.col("series_key").alias("index_name"),
        F.lit("daily").alias("duration"),
    )
    for _ in range(2):
        writers.append(rows, path, schema, unused=["duration"])
    return dated(readers.facts(t.spark, path, schema), "time")


@query(
    "snk4",
    """SELECT series_key, strftime(time, '%Y-%m-%d') AS time, close FROM bars
    WHERE time BETWEEN DATE '1996-03-15' AND DATE '1996-07-10'""",
    "bars",
)
def snk4(t):
    """Table with a folder per month, clustered by series; a range reads only its months."""
    path = new_folder(t.spark, "snk4")
    rows = t.bars.withColumn("time", F.col("time").cast("timestamp_ntz"))
    writers.to_month_table(rows, path, "time", ["series_key"])
    schema = "series_key string, time timestamp_ntz, close double, month string"
    table = t.spark.read.schema(schema).parquet(path)
    found = writers.month_table_range(table, "time", "1996-03-15", "1996-07-10")
    return dated(found.select("series_key", "time", "close"), "time")


@query(
    "snk4_buckets",
    f"SELECT {FACT}, industry FROM statement JOIN (SELECT stock_code, industry FROM companies) USING (stock_code)",
    "statement companies",
)
def snk4_buckets(t):
    """Facts and companies clustered by entity; their join moves no row."""
    clustered = (
        through_buckets(df, "snk4", "stock_code", 16)
        for df in (t.statement.select(*FACT.split(", ")), t.companies.select("stock_code", "industry"))
    )
    facts, companies = clustered
    return facts.join(companies.hint("merge"), "stock_code")


@query(
    "snk5",
    "SELECT url, source, true AS stamped FROM news UNION ALL SELECT url, source, true FROM news",
    "news",
)
def snk5(t):
    """Articles appended twice with creation times; both copies stay."""
    path = new_folder(t.spark, "snk5")
    for _ in range(2):
        writers.append_documents(t.news.drop("text"), path)
    rows = t.spark.read.parquet(path)
    stamped = F.col("created_at").isNotNull() & (F.col("created_at") == F.col("updated_at"))
    return rows.select("url", "source", stamped.alias("stamped"))


@query(
    "snk6",
    "SELECT split, index, id, question_raw AS content FROM indexed WHERE answer IS NOT NULL",
    "bars",
    _MARKET | {"indexed": _INDEXED},
)
def snk6(t):
    """Question records as JSON lines, a folder per split, with a running index."""
    path = new_folder(t.spark, "snk6")
    records = ds.as_records(split_questions(t)).withColumn("split", F.col("extra_info.split"))
    writers.to_split_json(records, path)
    rows = readers.good_lines(readers.json_lines(t.spark, path, schemas.QUESTION))
    return rows.select(
        F.col("extra_info.split").alias("split"),
        F.col("extra_info.index").alias("index"),
        F.col("extra_info.id").alias("id"),
        F.col("prompt")[0]["content"].alias("content"),
    )


@query(
    "snk7",
    """SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, text FROM benchmark""",
)
def snk7(t):
    """Training and test sets as parquet."""
    path = new_folder(t.spark, "snk7")
    split = F.when(F.col("item_id") % 4 == 0, "test").otherwise("train")
    t["benchmark"].withColumn("split", split).write.partitionBy("split").parquet(path)
    return t.spark.read.schema("item_id long, text string, split string").parquet(path)


@query(
    "snk8",
    """SELECT stock_code, category_code, year, quarter, CASE WHEN year >= 1999 THEN data * 2 ELSE data END AS data FROM statement""",
    "statement",
)
def snk8(t):
    """Newer snapshot over an older one, last row per key."""
    old = t.statement.select(*FACT.split(", "))
    new = old.where(F.col("year") >= 1999).withColumn("data", F.col("data") * 2)
    return st.keep_last(old, new, ["stock_code", "year", "quarter", "category_code"])


@query(
    "snk8_parts",
    """SELECT stock_code, category_code, year, quarter, CASE WHEN year >= 1999 THEN data * 2 ELSE data END AS data FROM statement""",
    "statement",
)
def snk8_parts(t):
    """Newer snapshot over a stored one with a folder per year; only its years are written, twice."""
    path = new_folder(t.spark, "snk8")
    # Written once: the table, and each of the two calls, take their rows from here.
    rows = through_table(t.statement.select("stock_code", "category_code", "quarter", "data", "year"), "snk8-rows")
    rows.write.partitionBy("year").parquet(path)
    new = rows.where(F.col("year") >= 1999).withColumn("data", F.col("data") * 2)
    for _ in range(2):
        writers.upsert_partitions(new, path, ["stock_code", "year", "quarter", "category_code"], ["year"])
    return t.spark.read.schema(rows.schema).parquet(path).select(*FACT.split(", "))


@query(
    "snk9_flags",
    "SELECT url, source, coalesce(url IN (SELECT url FROM points WHERE label % 3 = 0), false) AS vectorized FROM news",
    "news points",
)
def snk9_flags(t):
    """Processed articles flagged in a table with a folder per month; other months stay as they are."""
    path = new_folder(t.spark, "snk9")
    rows = t.news.select("url", "source", F.lit(None).cast("boolean").alias("vectorized"), F.date_format("pub_date", "yyyy-MM").alias("month"))
    rows.write.partitionBy("month").parquet(path)
    for _ in range(2):
        writers.set_flag(t.points.where("label % 3 = 0"), path, rows.schema, "url", "vectorized", ["month"])
    found = t.spark.read.schema(rows.schema).parquet(path)
    return found.select("url", "source", F.coalesce("vectorized", F.lit(False)).alias("vectorized"))


@query(
    "snk9",
    "SELECT url, source FROM news WHERE url NOT IN (SELECT url FROM points)",
    "news points",
)
def snk9(t):
    """Processed keys recorded; the next reader leaves them out."""
    path = new_folder(t.spark, "snk9")
    writers.mark_processed(t.points, path)
    done = t.spark.read.schema("url string").parquet(path)
    return t.news.join(done, "url", "left_anti").select("url", "source")


# -- streaming ---------------------------------------------------------------------------


#: Stored bytes of documents for each file of arriving articles; a task writes one file.
FILE_BYTES = 16 << 20


def article_files(t, label, columns=("url", "channel_name", "pub_date", "text"), least=4, codec="snappy"):
    """Articles as a folder of files that arrive one by one, plus its schema and the number of files.

    Files are as many as the documents need at ``FILE_BYTES`` each, ``least`` at least. Callers
    take a share of them a batch, so more input makes larger batches of more tasks.
    """
    path = new_folder(t.spark, label)
    rows = t.news.select(*columns)
    stored = readers.file_listing(t.spark, f"{t.dir}/documents.parquet").agg(F.sum("length")).first()[0]
    files = max(least, -(-(stored or 0) // FILE_BYTES))
    ordered = rows.repartitionByRange(files, "pub_date", "url").sortWithinPartitions("pub_date", "url")
    ordered.write.option("compression", codec).parquet(path)
    return path, rows.schema, files


#: Between the articles that str1 brings first and those it brings with them again.
MIDDLE = "2024-07-01"


@query(
    "str1",
    """SELECT url, channel_name FROM news LEFT JOIN (SELECT channel_name AS c, max(pub_date) AS mark FROM news
        WHERE pub_date < TIMESTAMP '2024-07-01' GROUP BY 1) ON c = channel_name
    WHERE pub_date < TIMESTAMP '2024-07-01' OR mark IS NULL OR pub_date > mark""",
    "news",
)
def str1(t):
    """High-water ingest of files in time order over several batches, old and new rows mixed."""
    path, schema, files = article_files(t, "str1", codec="zstd")
    target, mark = new_folder(t.spark, "str1-out"), new_folder(t.spark, "str1-cp")
    rows = t.spark.read.schema(schema).parquet(path)
    arriving = new_folder(t.spark, "str1-in")

    def again(names):
        return t.spark.read.schema(schema).parquet(*names)

    # First the older half, then everything: of the second arrival only the newer half is taken.
    for part in (rows.where(F.col("pub_date") < F.lit(MIDDLE).cast(schema["pub_date"].dataType)), rows):
        part.write.mode("append").option("compression", "zstd").parquet(arriving)
        stream = ingest.file_stream(t.spark, arriving, schema, files_per_batch=max(1000, 2 * files))
        # The channels are few: their rows are read again by file, not gathered by channel.
        ingest.high_water_ingest(stream, target, mark, again=again).awaitTermination()
    return t.spark.read.schema(schema).parquet(target).select("url", "channel_name")


@query(
    "str2",
    """SELECT url, len(text) AS length FROM news""",
    "news",
)
def str2(t):
    """Queue drained in batches; every article is worked on once."""
    path, schema, files = article_files(t, "str2")
    target, mark = new_folder(t.spark, "str2-out"), new_folder(t.spark, "str2-cp")

    def work(batch):
        return batch.select("url", F.length("text").cast("bigint").alias("length"))

    for _ in range(2):
        stream = ingest.file_stream(t.spark, path, schema, files_per_batch=-(-files // 2))
        ingest.drain(stream, work, target, mark).awaitTermination()
    return t.spark.read.schema("url string, length long").parquet(target).select("url", "length")


@query("str3", "SELECT url, channel_name FROM news", "news")
def str3(t):
    """Repeated arrivals dropped, over several batches."""
    path, schema, files = article_files(t, "str3")
    t.spark.read.schema(schema).parquet(path).write.mode("append").parquet(path)
    target, mark = new_folder(t.spark, "str3-out"), new_folder(t.spark, "str3-cp")
    stream = ingest.file_stream(t.spark, path, schema, files_per_batch=-(-3 * files // 4))
    ingest.first_arrivals(stream.select("url", "channel_name"), target, mark).awaitTermination()
    return t.spark.read.schema("url string, channel_name string").parquet(target).select("url", "channel_name")


@query(
    "vec4_stream",
    r"""SELECT 'doc://' || doc_id AS url, count(*) AS chunks, CAST(sum(length(part)) AS BIGINT) AS letters
    FROM (SELECT doc_id, unnest(parts) AS part FROM chunked) WHERE regexp_replace(part, '\s+', '', 'g') <> '' GROUP BY doc_id""",
    "",
    {"sentences": SENTENCES_SQL, "folded": FOLD_SQL, "chunked": CHUNKS_SQL},
)
def vec4_stream(t):
    """Chunk table filled incrementally from arriving articles; its chunks per article are compared."""
    path, schema, files = article_files(t, "vec4", ("url", "title", "pub_date", "text"), least=3)
    target, mark = new_folder(t.spark, "vec4-out"), new_folder(t.spark, "vec4-cp")
    stream = ingest.file_stream(t.spark, path, schema, files_per_batch=-(-files // 3))
    ingest.drain(stream, documents.chunk_table, target, mark).awaitTermination()
    chunks = t.spark.read.schema("url string, chunk string").parquet(target)
    return chunks.groupBy("url").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).cast("long").alias("letters")
    )


@query(
    "agg9_stream",
    """SELECT series_key, strftime(last_day(time), '%Y-%m-%d') AS time, arg_min(open, time) AS open, max(high) AS high,
        min(low) AS low, arg_max(close, time) AS close, CAST(sum(volume) AS BIGINT) AS volume
    FROM bars WHERE date_trunc('month', time) + INTERVAL 1 MONTH <= (SELECT max(time) FROM bars) - INTERVAL 10 DAY
    GROUP BY series_key, last_day(time)""",
    "bars",
)
def agg9_stream(t):
    """Monthly bars of a stream in three arrivals, the later ones with rows of closed months."""
    arriving, target, mark = (new_folder(t.spark, f"agg9-{x}") for x in ("in", "out", "cp"))
    rows = t.bars.select("series_key", F.col("time").cast("timestamp_ntz").alias("time"), "open", "high", "low", "close", "volume")
    late = F.pmod(F.xxhash64("series_key", "time"), F.lit(7)) == 0
    arrival = F.when(F.year("time") < 1995, F.when(late, 2).otherwise(0)).otherwise(F.when(late, 2).otherwise(1))
    for part in range(3):
        rows.where(arrival == part).write.mode("append").parquet(arriving)
        stream = ingest.file_stream(t.spark, arriving, rows.schema, files_per_batch=1000)
        bars.stream_bars(stream, target, mark, ["series_key"]).awaitTermination()
    found = bars.completed_bars(t.spark, target, ["series_key"])
    return found.select(
        "series_key", F.date_format(F.last_day("window"), "yyyy-MM-dd").alias("time"), "open", "high", "low", "close", "volume"
    )
