import json

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import datasets as ds
from tidemark.operators import sampling
from tidemark.sources import readers, writers


def test_gap_shares(spark):
    df = spark.range(20000).select("id", ds.ask_gap(F.col("id"), F.lit(True)).alias("q"), ds.ask_gap(F.col("id"), F.lit(False)).alias("m"))
    q = {r["q"]: r["count"] / 20000 for r in df.groupBy("q").count().collect()}
    m = {r["m"]: r["count"] / 20000 for r in df.groupBy("m").count().collect()}
    assert abs(q[3] - 0.45) < 0.02 and abs(q[2] - 0.45) < 0.02 and abs(q[1] - 0.10) < 0.02
    assert abs(m[2] - 0.5) < 0.02 and abs(m[1] - 0.5) < 0.02


def test_ask_date_snaps_to_month_end(spark):
    rows = [(2024, 2, True), (2024, 1, True), (2023, 3, False)]
    df = spark.createDataFrame(rows, "year int, time_val int, is_quarter boolean")
    got = ds.with_ask_date(df, F.lit("x")).collect()
    allowed = [{"2024-03-31", "2024-04-30", "2024-05-31"}, {"2023-12-31", "2024-01-31", "2024-02-29"}, {"2023-01-31", "2023-02-28"}]
    assert all(r["time_asked"] in a for r, a in zip(got, allowed))


def test_normalised_records(spark):
    lines = [
        '{"prompt": [{"role": "user", "content": 5}, "x", {"content": null}], "reward_model": {"ground_truth": "{\\"mean\\": \\"1.5\\"}"}, "extra_info": {"index": "x", "std": "0.5", "gap": 2}}',
        '{"prompt": "text", "reward_model": [1], "data_source": 7}',
        "[1]",
        "3",
        "{broken",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = ds.normalised_records(df).collect()
    assert len(got) == 2
    full = next(r for r in got if r["prompt"])
    assert [(m["role"], m["content"]) for m in full["prompt"]] == [("user", "5"), ("", "")]
    assert full["reward_model"]["ground_truth"].asDict() == {"mean": 1.5, "std": None}
    assert full["extra_info"]["index"] is None and full["extra_info"]["std"] == 0.5 and full["extra_info"]["gap"] == 2
    bare = next(r for r in got if not r["prompt"])
    assert bare["data_source"] == "7" and bare["reward_model"]["style"] == "" and bare["extra_info"]["id"] == ""


def test_json_lines_count_bad_ones(spark, tmp_path):
    good = json.dumps({"data_source": "a", "prompt": [], "ability": "x"})
    (tmp_path / "f.jsonl").write_text("\n".join([good, "", "  ", "{bad", "[1]", good]))
    lines = readers.json_lines(spark, str(tmp_path), schemas.QUESTION)
    assert readers.line_counts(lines).first().asDict() == {"kept": 2, "skipped": 2}
    assert readers.good_lines(lines).count() == 2


def test_records_drop_answers_that_are_no_numbers(spark):
    rows = [("q1", "1.5", None), ("q2", "N/A", 0.1)]
    df = spark.createDataFrame(rows, "question_raw string, answer_raw string, std double").select(
        "*", F.lit("train").alias("split"), F.lit(0).alias("index"), F.lit("2024-01-31").alias("time_asked"),
        F.lit(1).alias("gap"), F.lit("t").alias("type"), F.lit("i").alias("id"),
    )
    got = ds.as_records(df).collect()
    assert len(got) == 1 and got[0]["reward_model"]["ground_truth"]["std"] == 0.0
    assert got[0]["prompt"][0]["content"] == "q1" and got[0]["extra_info"]["std"] is None


def test_system_prompt_only_where_missing(spark):
    rows = [(1, [("user", "q")], ("2024-05-31",)), (2, [("system", "s"), ("user", "q")], ("2024-05-31",))]
    df = spark.createDataFrame(rows, "i int, prompt array<struct<role:string,content:string>>, extra_info struct<time_asked:string>")
    got = {r["i"]: r for r in ds.with_system_prompt(df, "It is {current_time}!").collect()}
    assert got[1]["prompt"][0]["content"] == "It is 2024-05-31!" and len(got[1]["prompt"]) == 2
    assert got[2]["prompt"][0]["content"] == "s" and got[2]["ability"] == "finance"


def test_sample_is_exact_and_stops_at_all(spark):
    df = spark.range(100)
    first = {r[0] for r in sampling.sample(df, F.col("id"), 30, 1).collect()}
    again = {r[0] for r in sampling.sample(df.repartition(7), F.col("id"), 30, 1).collect()}
    other = {r[0] for r in sampling.sample(df, F.col("id"), 30, 2).collect()}
    assert len(first) == 30 and first == again and first != other
    assert sampling.sample(df, F.col("id"), 4000).count() == 100


def test_quota_takes_preferred_first(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).alias("kind"))
    def pick(quota):
        got = sampling.quota_sample(df, F.col("id"), F.col("kind") != 0, F.col("kind") == 1, quota)
        return {r["kind"]: r["count"] for r in got.groupBy("kind").count().collect()}
    assert pick(40) == {0: 100, 1: 40}
    assert pick(130) == {0: 100, 1: 100, 2: 30}
    assert pick(999) == {0: 100, 1: 100, 2: 100}


def test_load_drops_rows_without_required_values(spark, tmp_path):
    df = spark.sql("SELECT 'a' AS k, DATE'2020-01-01' AS time, 1.0D AS close, 1L AS volume, 'daily' AS duration UNION ALL SELECT 'a', NULL, 2.0D, 1L, 'daily' UNION ALL SELECT 'a', DATE'2020-01-02', NULL, 1L, 'daily'")
    schema = schemas.series("k", ())
    for _ in range(2):
        writers.append(df, str(tmp_path / "t"), schema, unused=["duration"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_newest_file_wins(spark, tmp_path):
    import os

    for i, (name, value) in enumerate((("A_old", 1), ("A_new", 2), ("B_x", 3))):
        path = str(tmp_path / f"{name}.json")
        with open(path, "w") as f:
            f.write(json.dumps({"v": value}))
        os.utime(path, (1_600_000_000 + i * 100, 1_600_000_000 + i * 100))
    got = readers.latest_files(spark, str(tmp_path), "v long", r"/([A-Z])_[a-z]+\.json", "json").collect()
    assert sorted((r["entity"], r["v"]) for r in got) == [("A", 2), ("B", 3)]
