"""Every registered track query runs, and equals its SQL where it has one."""

import duckdb
import pandas as pd
import pytest

from waymill import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)
    one = lambda x: "" if pd.isna(x) else int(x) if isinstance(x, (int, bool)) or hasattr(x, "__index__") else round(float(x), 9) if isinstance(x, float) else str(x)
    return sorted(tuple(map(str, map(one, r))) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, duck, name):
    frame = q.queries()[name](spark, SF)
    got = frame.toPandas()
    assert list(got.columns) == frame.columns
    if name in q.ORACLES:
        want = duck.execute(q.ORACLES[name]).fetchdf()
        assert sorted(want.columns) == sorted(got.columns)
        assert rows(got) == rows(want)


def test_names_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert 'track_length' in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], check=True, timeout=120)


def test_set_like_rules_stay_in_the_jvm(spark):
    for name in ("track_length", "islands", "speed_window", "smooth_weight", "gaps", "spread_penalty", "lonely"):
        plan = q.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_columns_reach_the_scan(spark):
    plan = q.queries()["track_length"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "event_id" in schema and "props" not in schema
