import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tidemark.operators import ratios, series
from tidemark.operators import statements as st
from tidemark.sources import workspace, writers
from tidemark.streaming import bars, ingest

SF = "/root/testdata/sf0.001"
SCHEMA = "url string, channel_name string, pub_date timestamp"


def put(spark, folder, rows):
    df = spark.createDataFrame(rows, "url string, channel_name string, d string")
    df.select("url", "channel_name", F.col("d").cast("timestamp").alias("pub_date")).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    return ingest.file_stream(spark, folder, schema)


def test_late_article_is_not_taken(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    put(spark, src, [("u1", "a", "2024-01-05"), ("u2", "b", "2024-01-01")])
    ingest.high_water_ingest(stream(spark, src), out, cp).awaitTermination()
    put(spark, src, [("u3", "a", "2024-01-04"), ("u4", "a", "2024-01-06"), ("u5", "b", "2024-01-02"), ("u6", "c", "2020-01-01"), ("u7", "a", "2024-01-05")])
    ingest.high_water_ingest(stream(spark, src), out, cp).awaitTermination()
    got = {r["url"] for r in spark.read.parquet(out).collect()}
    assert got == {"u1", "u2", "u4", "u5", "u6"}


def replayed(checkpoint):
    """Forget that the last batch was finished, as after a crash before its commit."""
    commits = [f for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()]
    last = max(commits, key=int)
    os.remove(f"{checkpoint}/commits/{last}")
    hidden = f"{checkpoint}/commits/.{last}.crc"
    if os.path.exists(hidden):
        os.remove(hidden)
    return int(last)


def test_marks_without_channel_or_time(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    put(spark, src, [("u1", None, "2024-01-05"), ("u2", "a", None), ("u3", "b", "2024-01-05"), ("u4", "b", None)])
    put(spark, src, [("u5", None, "2023-01-05"), ("u6", "a", None), ("u7", "b", None), ("u8", "a", "2020-01-01")])
    put(spark, src, [("u9", "a", "2019-01-01"), ("v1", "a", "2020-01-02"), ("v2", None, None), ("v3", "b", "2024-01-05")])
    for _ in range(2):
        ingest.high_water_ingest(stream(spark, src), out, cp).awaitTermination()
    got = spark.read.parquet(out)
    assert got.columns == ["url", "channel_name", "pub_date"]
    assert {r["url"] for r in got.collect()} == {"u1", "u2", "u3", "u4", "u5", "u6", "u8", "v1", "v2"}


@pytest.mark.parametrize("take", ["high_water_ingest", "first_arrivals"])
def test_a_batch_reads_its_own_files_and_can_be_run_again(spark, tmp_path, take):
    """Five batches, the last one run twice: its input is its file, and its rows stand once."""
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for day in range(1, 6):
        rows = [(f"u{day}-{i}", f"c{i % 3}", f"2024-01-{day:02d} 0{i}:00:00") for i in range(6)]
        put(spark, src, rows + rows[:2])
        query = getattr(ingest, take)(stream(spark, src), out, cp)
        query.awaitTermination()
        progress = [p for p in query.recentProgress if p["numInputRows"]]
        assert [p["numInputRows"] for p in progress] == [8]
        assert progress[0]["stateOperators"][0]["numRowsTotal"] == (3 if take == "high_water_ingest" else 6 * day)
    want = sorted(r["url"] for r in spark.read.parquet(out).collect())
    assert replayed(cp) >= 4
    getattr(ingest, take)(stream(spark, src), out, cp).awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(out).collect()) == want
    assert len(want) == (40 if take == "high_water_ingest" else 30)
    late = [("late", "c0", "2024-01-02"), ("u1-0", "c1", "2024-02-01"), ("new", "c1", "2024-02-01")]
    put(spark, src, late)
    getattr(ingest, take)(stream(spark, src), out, cp).awaitTermination()
    more = {"u1-0", "new"} if take == "high_water_ingest" else {"late", "new"}
    assert sorted(r["url"] for r in spark.read.parquet(out).collect()) == sorted([*want, *more])


def test_files_read_again_give_what_gathered_channels_give(spark, tmp_path):
    """Marks without channel or time, late rows, repeats, a file without rows, a batch run again; long numbers stay whole."""
    columns = "url string, channel_name string, d string, n long, seen boolean, share double"
    arrivals = [
        [],
        [("u1", "a", "2024-01-05"), ("u2", None, "2024-01-05"), ("u3", "b", None), ("u4", "c", "2024-01-03")],
        [(f"v{i}", "a", f"2024-01-{i:02d}") for i in range(1, 10)] + [("v6", "a", "2024-01-06"), ("w1", "b", None), ("w2", "b", "2020-01-01")],
        [(None, "a", "2024-01-09"), (None, "a", "2024-01-10"), ("x1", None, None), ("x2", "b", None), ("x3", "b", "2020-01-01"), ("x4", "c", "2024-01-04"), ("x5", "d", None)],
        [("y1", "a", "2024-01-10"), ("y2", "d", "2019-01-01"), ("y3", "c", "2024-01-03"), ("y4", "b", "2020-01-02")],
    ]
    src = str(tmp_path / "arriving 100%")
    schema = spark.createDataFrame([], columns).withColumn("pub_date", F.col("d").cast("timestamp")).drop("d").schema

    def again(files):
        return spark.read.schema(schema).parquet(*files)

    for number, rows in enumerate(arrivals):
        df = spark.createDataFrame([(*r, 2**60 + i, i % 2 == 0, i / 4) for i, r in enumerate(rows)], columns)
        df = df.withColumn("pub_date", F.col("d").cast("timestamp")).drop("d")
        df.repartition(2, "url").write.mode("append").parquet(src)
        found = []
        for way in (None, again):
            out, cp = (str(tmp_path / f"{x}-{way is None}") for x in ("out", "cp"))
            files = ingest.file_stream(spark, src, schema, files_per_batch=100)
            query = ingest.high_water_ingest(files, out, cp, again=way)
            query.awaitTermination()
            assert sum(p["numInputRows"] for p in query.recentProgress) == len(rows)
            if number == 3:
                assert replayed(cp) == number
                ingest.high_water_ingest(files, out, cp, again=way).awaitTermination()
            found.append(sorted(map(str, spark.read.schema(schema).parquet(out).select(schema.names).collect())))
        assert found[0] == found[1]
    taken = spark.read.schema(schema).parquet(out)
    assert sorted(str(r["url"]) for r in taken.collect()) == sorted("u1 u2 u3 u4 v6 v6 v7 v8 v9 w1 w2 None x1 x4 x5 y2 y4".split())
    assert taken.where("url = 'u2'").first()["n"] == 2**60 + 1


def test_articles_of_few_channels_are_not_gathered(spark, monkeypatch):
    started, ingested = [], ingest.high_water_ingest
    monkeypatch.setattr(ingest, "high_water_ingest", lambda *a, **b: started.append(ingested(*a, **b)) or started[-1])
    channels = contract.queries()["str1"](spark, SF).select("channel_name").distinct().count()
    for query in started:
        text = query._jsq.explainInternal(False)
        assert "FlatMapGroupsInPandasWithState" in text and "channel_name#" in text and "text#" not in text
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == channels
    assert len(started) == 2


def test_queue_is_drained_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for i in range(3):
        put(spark, src, [(f"u{i}", "a", "2024-01-01")])
    for _ in range(2):
        ingest.drain(stream(spark, src), lambda b: b.select("url"), out, cp).awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(out).collect()) == ["u0", "u1", "u2"]


def test_repeats_are_dropped_across_files(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    put(spark, src, [("u1", "a", "2024-01-01"), ("u2", "a", "2024-01-02")])
    put(spark, src, [("u1", "a", "2024-01-03")])
    put(spark, src, [("u3", "a", "2022-01-03"), ("u2", "a", "2026-01-01"), (None, "a", "2024-01-01")])
    put(spark, src, [(None, "b", "2024-01-01"), ("u4", "a", "2020-05-05")])
    for _ in range(2):
        ingest.first_arrivals(stream(spark, src), out, cp).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert sorted(str(r["url"]) for r in got) == ["None", "u1", "u2", "u3", "u4"]


BAR = "key string, time timestamp_ntz, open double, high double, low double, close double, volume long"


def bar(key, time, x, volume=1):
    return (key, dt.datetime.fromisoformat(time) if time else None, x, None if x is None else x + 1, x, x, volume)


def test_bars_close_behind_the_watermark_and_late_rows_are_kept(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    arrivals = [
        [bar("a", "2024-01-05", 1.0), bar("a", "2024-01-20", 3.0), bar("b", "2024-02-09", 5.0)],
        # The watermark is 30 January: January is open still.
        [bar("a", "2024-01-02", 9.0), bar("b", "2024-02-20", 7.0), bar("a", "2024-01-25", None)],
        # 10 February: January is closed; its rows are late, February is open.
        [bar("a", "2024-01-01", 2.0), bar("c", "2024-01-31", 2.0), bar("b", "2024-02-01", 4.0), bar("a", None, 8.0)],
        # Nothing newer, all late.
        [bar("a", "2023-12-31", 6.0)],
        [bar("b", "2024-03-20", 6.0)],
    ]
    seen = []
    for rows in arrivals:
        spark.createDataFrame(rows, BAR).coalesce(1).write.mode("append").parquet(src)
        stream = ingest.file_stream(spark, src, spark.createDataFrame([], BAR).schema)
        query = bars.stream_bars(stream, out, cp, ["key"])
        query.awaitTermination()
        assert query.lastProgress["numInputRows"] <= 2 * len(rows)  # its own files, for bars and for late rows
        late = spark.read.parquet(f"{out}/late").count()
        seen.append((spark.read.parquet(f"{out}/bars").count(), late))
    assert seen == [(0, 0), (1, 0), (1, 3), (1, 4), (2, 4)]
    closed = {(r["key"], r["window"].month): r for r in spark.read.parquet(f"{out}/bars").collect()}
    jan, feb = closed["a", 1], closed["b", 2]
    assert (jan.open, jan.high, jan.low, jan.close, jan.volume) == (9.0, 10.0, 1.0, 3.0, 4)
    assert (feb.open, feb.high, feb.low, feb.close, feb.volume) == (4.0, 8.0, 4.0, 7.0, 3)
    full = {(r["key"], r["window"].isoformat()[:7]): r for r in bars.completed_bars(spark, out, ["key"]).collect()}
    assert set(full) == {("a", "2024-01"), ("b", "2024-02"), ("c", "2024-01"), ("a", "2023-12")}
    assert (full["a", "2024-01"].open, full["a", "2024-01"].close, full["a", "2024-01"].volume) == (2.0, 3.0, 5)

    before = sorted(map(str, bars.completed_bars(spark, out, ["key"]).collect()))
    for f in ("commits/4", "commits/.4.crc"):
        os.remove(f"{cp}/{f}")
    bars.stream_bars(stream, out, cp, ["key"]).awaitTermination()
    assert sorted(map(str, bars.completed_bars(spark, out, ["key"]).collect())) == before


# -- plans ---------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bars_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bars") / "t")
    rows = spark.range(1000).select(
        F.concat(F.lit("k"), (F.col("id") % 4).cast("string")).alias("key"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("time"),
        F.col("id").cast("double").alias("close"), F.lit(1).alias("volume"), F.lit("x").alias("unused"),
    )
    rows.write.parquet(path)
    return path


def test_range_read_pushes_filters_and_columns(spark, bars_path):
    df = series.series_range(spark.read.parquet(bars_path), "key", "k1", "2020-02-01", "2020-03-01", ["close"])
    text = plan(df)
    pushed = text.split("PushedFilters: ")[1].split("]")[0]
    assert "EqualTo(key,k1)" in pushed and "GreaterThanOrEqual(time" in pushed
    assert "unused" not in text.split("ReadSchema: ")[1]


def test_month_table_reads_only_its_months(spark, bars_path, tmp_path):
    rows = spark.read.parquet(bars_path).withColumn("time", F.col("time").cast("timestamp_ntz"))
    path = str(tmp_path / "m")
    writers.to_month_table(rows, path, "time", ["key"])
    found = writers.month_table_range(spark.read.parquet(path), "time", "2020-02-10", "2020-03-05")
    assert "month" in plan(found).split("PartitionFilters: ")[1].split("]")[0]
    assert found.count() == 25


def test_all_families_share_one_scan_and_two_exchanges(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = [("A", 2000, q, c, 1.0) for q in range(5) for c in ratios.rb.account_codes(ratios.rb.CORP)]
    spark.createDataFrame(rows, "stock_code string, year int, quarter int, category_code string, data double").write.parquet(path)
    codes = ratios.rb.account_codes(ratios.rb.CORP)
    text = plan(ratios.financial_ratios(spark.read.parquet(path), "corp", codes=codes))
    initial = text.split("Initial Plan")[-1]
    assert initial.count("FileScan") == 1
    assert initial.count("Exchange hashpartitioning") == 2


def test_top_entities_are_limited_before_the_shuffle(spark):
    facts = spark.createDataFrame([("A", 2000, 0, "BS_400", 1.0)], "stock_code string, year int, quarter int, category_code string, data double")
    companies = spark.createDataFrame([("A", "x")], "stock_code string, industry string")
    assert "WindowGroupLimit" in plan(st.largest_entities(facts, companies, top=2))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", "flt1 flt12 agg4 agg7 win4 jn5 jn7 jn9 jn13 txt1 vec2 qa1 qa8 smp3 job1".split())
def test_no_cross_joins(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert workspace.shared_folder(spark) == configured
    df = workspace.through_table(spark.range(3), "x")
    assert df.count() == 3 and configured in df.inputFiles()[0]


def test_averages_scan_and_shuffle_the_data_once(spark, bars_path):
    from tidemark.operators.ordered import moving_averages

    df = spark.read.parquet(bars_path).select("key", "time", "close")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(moving_averages(df, ["key"], "time", "close", (20, 50)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("FileScan") == 1 and text.count("ReusedExchange") == 2


# -- size of batches and files ---------------------------------------------------


def test_few_rows_at_a_time_go_to_python_workers(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    put(spark, src, [(f"u{i}", "a", "2024-01-05") for i in range(1200)])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    query = ingest.high_water_ingest(stream(spark, src), out, cp)
    assert query._jsq.streamingQuery().sparkSessionForStream().conf().get(name) == str(ingest.BATCH_ROWS)
    query.awaitTermination()
    assert spark.conf.get(name) == before
    assert spark.read.parquet(out).count() == 1200


def test_arriving_files_follow_the_input(spark, monkeypatch):
    from tidemark.plans import catalog_io
    from tidemark.plans.derived_views import Tables

    t = Tables(spark, SF)
    stored = os.path.getsize(f"{SF}/documents.parquet")
    monkeypatch.setattr(catalog_io, "FILE_BYTES", stored // 9)
    path, schema, files = catalog_io.article_files(t, "test")
    written = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(written) == files == 10 and spark.read.schema(schema).parquet(path).count() == t.news.count()
    for name in ("str1", "str2", "str3", "vec4_stream"):
        assert contract.queries()[name](spark, SF).count() == t.news.count(), name


# -- ratio table -----------------------------------------------------------------


def facts_of(n):
    codes = ratios.rb.account_codes(ratios.rb.CORP)
    rows = [(f"S{i}", 2000, q, c, float(i * 7 % 11 + j)) for i in range(n) for q in range(5) for j, c in enumerate(codes)]
    rows = [(*r, dt.date(2000, 12 if r[2] == 0 else r[2] * 3, 30)) for r in rows]
    return rows, "stock_code string, year int, quarter int, category_code string, data double, date_added date", codes


def test_ratio_codes_are_sent_to_the_rows(spark):
    rows = spark.range(10).selectExpr("concat('EBIT', substr(cast(id AS string), 9)) AS function_name", "id")
    text = plan(ratios.with_ratio_codes(rows))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_trailing_rows_read_the_facts_once(spark, tmp_path):
    from tidemark.plans import statement_tables

    path = str(tmp_path / "facts")
    rows, schema, _ = facts_of(2)
    rows = [r for r in rows if not r[3].endswith("_TTM")]
    spark.createDataFrame(rows, schema).write.parquet(path)
    found = statement_tables.with_trailing_rows(spark.read.parquet(path))
    assert plan(found).split("Initial Plan")[-1].count("FileScan") == 1
    assert found.where("category_code LIKE '%_TTM' AND quarter <> 4").isEmpty()
    one = found.where("stock_code = 'S1' AND category_code LIKE 'IS%TTM'").first()
    own = [r[4] for r in rows if r[0] == "S1" and r[2] and r[3] + "_TTM" == one.category_code]
    assert len(own) == 4 and one.data == sum(own)


def test_industry_means_make_ratios_of_members_only(spark, tmp_path):
    from tidemark.plans import ratio_tables

    path = str(tmp_path / "facts")
    rows, schema, codes = facts_of(9)
    spark.createDataFrame(rows, schema).write.parquet(path)
    facts = spark.read.parquet(path)
    companies = spark.createDataFrame([(f"S{i}", "xy"[i % 2]) for i in range(9)], "stock_code string, industry string")
    got = ratio_tables.industry_means({"corp": facts}, companies, top=2)
    want = st.industry_ratios(ratio_tables.segment_ratios(facts, "corp", codes=codes), facts, companies, top=2)
    assert "LeftSemi" in plan(got)
    rounded = [sorted(tuple(r.asDict().values()) for r in df.withColumn("data_mean", F.round("data_mean", 6)).collect()) for df in (got, want.select(got.columns))]
    assert rounded[0] == rounded[1] and rounded[0]
    table = ratio_tables.ratio_table({"corp": facts}, companies, top=2)
    assert table.where("segment = 'industry'").count() == len(rounded[0])
    assert table.where("segment = 'corp'").count() == ratio_tables.segment_ratios(facts, "corp", codes=codes).count()
