"""Every registered query against its comparison SQL.

TIDEMARK_SF names the table folder.
"""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.compare import TABLES, rows_of

SF = os.environ.get("TIDEMARK_SF", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_rows(spark, sql, name):
    df = contract.queries()[name](spark, SF)
    cursor = sql.execute(contract.oracle_sql()[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    got = rows_of(df.columns, df.collect())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_inventory_id_is_registered():
    wanted = (
        [f"src{i}" for i in range(1, 7)]
        + [f"snk{i}" for i in range(1, 10)]
        + [f"flt{i}" for i in range(1, 26)]
        + [f"jn{i}" for i in range(1, 15)]
        + [f"agg{i}" for i in range(1, 19)]
        + [f"win{i}" for i in range(1, 15)]
        + [f"srt{i}" for i in range(1, 7)]
        + [f"smp{i}" for i in range(1, 4)]
        + [f"set{i}" for i in range(1, 5)]
        + [f"scl{i}" for i in range(1, 30)]
        + [f"txt{i}" for i in range(1, 11)]
        + [f"vec{i}" for i in range(1, 5)]
        + [f"job{i}" for i in range(1, 11)]
        + [f"qa{i}" for i in range(1, 12)]
        + ["evl1", "evl2", "str1", "str2", "str3"]
        + "rat_struct rat_liq rat_risk rat_inc rat_prof rat_cash rat_avg rat_avgttm rat_pe rat_days "
        "rat_yoy rat_qoq rat_itr rat_cof rat_notes rat_assemble rat_ind".split()
    )
    assert set(wanted) <= set(contract.queries())
