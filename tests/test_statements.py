import pytest
from pyspark.sql import functions as F

from tidemark.operators import growth, guards, lookup, ratios
from tidemark.operators import ratio_bindings as rb
from tidemark.operators import statements as st
from tidemark.plans import ratio_tables


def facts(spark, rows):
    return spark.createDataFrame(
        rows, "stock_code string, year int, quarter int, category_code string, data double"
    )


def table(df, *keys):
    return {tuple(r[k] for k in keys): r["data"] for r in df.collect()}


def test_range_guard():
    assert guards.limited_range("2022-01-01", "2023-01-01", "2022-06-30") == ("2022-01-01", "2022-06-30")
    assert guards.limited_range("2022-01-01", "2023-01-01") == ("2022-01-01", "2023-01-01")
    with pytest.raises(ValueError, match="after the limit"):
        guards.limited_range("2023-01-01", "2023-02-01", "2022-06-30")
    with pytest.raises(ValueError, match="before start"):
        guards.limited_range("2022-05-01", "2022-04-01", "2022-06-30")


def test_end_day_is_midnight_unless_asked(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-05 10:00:00' AS t UNION ALL SELECT timestamp_ntz'2024-03-05 00:00:00'")
    assert df.where(guards.in_range(F.col("t"), "2024-03-01", "2024-03-05")).count() == 1
    assert df.where(guards.in_range(F.col("t"), "2024-03-01", "2024-03-05", True)).count() == 2


def test_trailing_sum_of_constant_and_gap(spark):
    rows = [("A", 2000 + i // 4, i % 4 + 1, "IS_010", 5.0) for i in range(8) if i != 5]
    df = facts(spark, rows).withColumn("date_added", F.lit(None).cast("date"))
    strict = table(growth.trailing_twelve_months(df), "year", "quarter")
    loose = table(growth.trailing_twelve_months(df, calendar=False), "year", "quarter")
    assert strict == {(2000, 4): 20.0, (2001, 1): 20.0}
    assert loose == {(2000, 4): 20.0, (2001, 1): 20.0, (2001, 3): 20.0, (2001, 4): 20.0}


def test_growth_of_constant_is_zero_and_first_year_undefined(spark):
    rows = [("A", y, q, "BS_270", 9.0) for y in (2000, 2001) for q in range(5)]
    got = ratios.financial_ratios(facts(spark, rows), "corp", ("yoy",))
    assets = got.where("function_name = 'Total_Asset_Growth_YoY'")
    values = table(assets, "year", "quarter")
    assert all(values[(2000, q)] is None and values[(2001, q)] == 0.0 for q in range(5))


def test_first_quarter_compares_with_last_years_fourth(spark):
    rows = [("A", 2000, 4, "BS_270", 10.0), ("A", 2001, 0, "BS_270", 99.0), ("A", 2001, 1, "BS_270", 15.0), ("A", 2001, 3, "BS_270", 20.0)]
    got = ratios.financial_ratios(facts(spark, rows), "corp", ("qoq",))
    values = table(got.where("function_name = 'Total_Asset_Growth_QoQ'"), "year", "quarter")
    assert values == {(2000, 4): None, (2001, 1): 0.5, (2001, 3): None}


def test_account_never_reported_counts_as_zero_in_growth_sums(spark):
    rows = [("A", y, 0, "BS_131", float(v)) for y, v in ((2000, 10), (2001, 15))]
    rows += [("B", 2000, 0, "BS_131", 1.0), ("B", 2000, 0, "BS_211", 1.0), ("B", 2001, 0, "BS_131", 4.0)]
    got = ratios.financial_ratios(facts(spark, rows), "corp", ("yoy",))
    values = table(got.where("function_name = 'Accounts_Receivable_Growth_YoY'"), "stock_code", "year")
    assert values[("A", 2001)] == 0.5  # BS_211 is reported by B only
    assert values[("B", 2001)] is None  # B's gap stays a gap


def test_zero_denominators_and_missing_accounts(spark):
    rows = [("A", 2000, 0, "BS_400", 4.0), ("A", 2000, 0, "BS_270", 0.0), ("A", 2000, 0, "IS_050", 3.0), ("B", 2000, 0, "BS_400", 1.0)]
    got = table(
        ratios.financial_ratios(facts(spark, rows), "corp", ("structure",)), "stock_code", "function_name"
    )
    assert got[("A", "equity_ratio")] is None and got[("B", "equity_ratio")] is None
    assert got[("A", "EBIT")] == 3.0  # interest is not reported by anyone
    assert ("A", "debt_to_assets_ratio") not in got  # liabilities are not reported by anyone


def test_book_value_per_share(spark):
    rows = [("A", 2000, 0, c, v) for c, v in (("Price", 30.0), ("IS_070", 2.0), ("IS_060", 10.0), ("BS_400", 50.0))]
    rows += [("Z", 2000, 0, c, v) for c, v in (("Price", 30.0), ("IS_070", 0.0), ("IS_060", 10.0), ("BS_400", 50.0))]
    got = table(ratios.financial_ratios(facts(spark, rows), "corp", ("price",)), "stock_code", "function_name")
    assert got[("A", "book_value_per_share")] == 10.0 and got[("A", "price_to_book_ratio")] == 3.0
    assert got[("Z", "book_value_per_share")] == 0.0
    assert got[("Z", "price_earning_ratio")] is None and got[("Z", "price_to_book_ratio")] is None


def test_averages_need_a_prior_annual_figure(spark):
    rows = [("A", y, q, c, v) for y, v in ((2000, 10.0), (2001, 30.0)) for q in (0, 1) for c in ("IS_060", "BS_270")]
    got = table(
        ratios.financial_ratios(facts(spark, rows), "corp", ("average",)), "year", "quarter", "function_name"
    )
    assert got == {
        (2001, 0, "return_on_average_assets"): 1.5,
        (2001, 1, "return_on_average_assets"): 1.5,
    }


def test_averaging_option_reaches_companies(spark):
    rows = [("A", y, 0, c, v) for y, v in ((2000, 10.0), (2001, 30.0)) for c in ("CF_050", "BS_300")]
    plain = table(ratios.financial_ratios(facts(spark, rows), "corp", ("cashflow",)), "year", "function_name")
    averaged = table(
        ratios.financial_ratios(facts(spark, rows), "corp", ("cashflow",), averaging="all"), "year", "function_name"
    )
    assert plain[(2000, "cash_debt_coverage_ratio")] == 1.0
    assert averaged[(2001, "cash_debt_coverage_ratio")] == 1.5
    assert (2000, "cash_debt_coverage_ratio") not in averaged
    # Both revenue accounts are absent, so the divisor is an empty sum.
    assert averaged[(2001, "cash_flow_margin")] is None


def test_ratio_of_a_ratio_only_on_request(spark):
    rows = [("A", 2000, 0, c, v) for c, v in (("CF_050", 10.0), ("CF_051", 2.0), ("CF_078", 3.0))]
    name = "free_cash_flow_to_operating_cash_flow_ratio"
    plain = table(ratios.financial_ratios(facts(spark, rows), "corp", ("cashflow",)), "function_name")
    derived = table(
        ratios.financial_ratios(facts(spark, rows), "corp", ("cashflow",), derived_inputs=True), "function_name"
    )
    assert (name,) not in plain and derived[(name,)] == 0.5


def test_name_bound_twice_gives_two_rows_only_if_values_differ(spark):
    rows = [("A", 2000, 0, c, v) for c, v in (("BS_300", 6.0), ("BS_410", 2.0), ("BS_400", 3.0))]
    rows += [("B", 2000, 0, c, v) for c, v in (("BS_300", 6.0), ("BS_410", 2.0), ("BS_400", 2.0))]
    got = ratios.financial_ratios(facts(spark, rows), "securities", ("structure", "liquidity"))
    found = got.where("function_name = 'debt_to_equity_ratio'").groupBy("stock_code").count()
    assert {r["stock_code"]: r["count"] for r in found.collect()} == {"A": 2, "B": 1}


def test_days_ratios_and_ttm_rows_in_the_table(spark):
    rows = [("A", 2000, q, c, v) for q in (0, 1) for c, v in (("BS_130", 1.0), ("IS_010", 2.0), ("IS_060_TTM", 4.0), ("BS_270", 2.0))]
    df = facts(spark, rows).withColumn("date_added", F.lit("2000-12-30").cast("date"))
    got = ratio_tables.segment_ratios(df, "corp", families=("days", "profitability"))
    values = table(got, "quarter", "ratio_code")
    assert values[(0, "DSO")] == 182.5 and values[(1, "DSO")] == 45.0
    assert values[(1, "ROATTM")] == 2.0 and (0, "ROATTM") not in values


def test_ratio_names_are_complete():
    names = rb.ratio_names()
    assert len(names) == 123
    for bindings in rb.BINDINGS.values():
        for family, entries in bindings.items():
            if family != "growth":
                assert set(entries) <= set(names)


def test_derived_account_carries_date_and_needs_all_parts(spark):
    df = facts(spark, [("A", 2000, 1, "X", 5.0), ("A", 2000, 1, "Y", 2.0), ("B", 2000, 1, "X", 1.0)])
    df = df.withColumn("date_added", F.lit("2000-03-30").cast("date"))
    got = st.derived_account(df, "Z", ["X"], ["Y"]).where("category_code = 'Z'").orderBy("stock_code").collect()
    assert [(r["stock_code"], r["data"], r["date_added"].isoformat()) for r in got] == [
        ("A", 3.0, "2000-03-30"),
        ("B", None, "2000-03-30"),
    ]


def test_keep_last_takes_new_rows(spark):
    old = facts(spark, [("A", 2000, 1, "X", 1.0), ("A", 2000, 2, "X", 2.0)])
    new = facts(spark, [("A", 2000, 2, "X", 9.0), ("B", 2000, 1, "X", 3.0)])
    keys = ["stock_code", "year", "quarter", "category_code"]
    assert table(st.keep_last(old, new, keys), "stock_code", "quarter") == {("A", 1): 1.0, ("A", 2): 9.0, ("B", 1): 3.0}


def test_captions_follow_the_template_once(spark):
    rows = [("f", i, c) for i, c in enumerate([" cash ", "loans", "other", "cash", "equity"])]
    df = spark.createDataFrame(rows, "file string, line int, caption string")
    got = st.aligned_captions(df, "file", "line", "caption", [("C1", "cash"), ("C2", "loans"), ("C3", "cash"), ("C4", "debt"), ("C5", "equity")])
    assert [r["category_code"] for r in got.orderBy("line").collect()] == ["C1", "C2", None, "C3", None]


def test_peers_leave_out_the_company_itself(spark):
    rows = [(f"S{i}", f"n{i}", "x", "e", float(i)) for i in range(8)] + [("T", "t", "y", "e", 1.0), ("U", "u", None, "e", 1.0)]
    df = spark.createDataFrame(rows, "stock_code string, company_name string, industry string, exchange string, issue_share double")
    got = lookup.all_similar_companies(df, top=3).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["place"]):
        by.setdefault(r["subject"], []).append(r["peer"])
    assert by["S7"] == ["S6", "S5", "S4"] and by["S0"] == ["S7", "S6", "S5"] and "T" not in by and "U" not in by
    one = [r["stock_code"] for r in lookup.similar_companies(df, "S6", 3).collect()]
    assert one == ["S7", "S5", "S4"]


def test_reconciliation_reads_each_side_once(spark, tmp_path):
    from tidemark.operators import quality

    for name, codes in (("fact", ["a", "a", "b", None]), ("mapping", ["b", "c", None])):
        spark.createDataFrame([(c,) for c in codes], "category_code string").write.parquet(str(tmp_path / name))
    found = quality.reconciliation(*(spark.read.parquet(str(tmp_path / n)) for n in ("fact", "mapping")))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    assert sorted(map(tuple, found.collect())) == [("a", "mapping"), ("c", "fact")]


def test_empty_months_without_join(spark):
    from tidemark.operators import series

    rows = spark.createDataFrame(
        [("a", "1999-11-05", 1.0), ("a", "1999-11-09", 2.0), ("a", "2000-02-01", 3.0), ("b", "2000-01-01", 4.0)], "k string, d string, x double"
    ).withColumn("d", F.to_date("d"))
    found = series.month_end_last(rows, ["k"], "d", ["x"], empty_months=True)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.k, str(r.d), r.x) for r in found.collect())
    assert got == [("a", "1999-11-30", 2.0), ("a", "1999-12-31", None), ("a", "2000-01-31", None), ("a", "2000-02-29", 3.0), ("b", "2000-01-31", 4.0)]


def test_period_labels_are_those_of_the_statements(spark):
    from tidemark.plans import catalog_statements
    from tidemark.plans.derived_views import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    assert catalog_statements.period_labels(t) == sorted(r[0] for r in catalog_statements.raw(t).select("time").distinct().collect())
