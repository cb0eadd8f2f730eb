"""Every registered query against its SQL."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from cairn import plans


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    def plain(v):
        if pd.isna(v):
            return None
        if isinstance(v, float):
            return f"{v:.6g}"
        return str(v)[:10] if hasattr(v, "year") else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.astype(object).values.tolist()), key=str)


def number(text):
    """Integers that pandas made floats of read as integers."""
    try:
        return f"{float(text):.6g}"
    except (TypeError, ValueError):
        return text


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, folder, duck, name):
    ours, theirs = plans.QUERIES[name](spark, folder).toPandas(), duck.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = [[[number(v) for v in r] for r in rows(x)] for x in (ours, theirs)]
    assert sorted(a, key=str) == sorted(b, key=str)


def test_the_query_without_sql_is_held_against_a_plain_loop():
    """In test_whole.py, on its own rows."""
    assert set(plans.QUERIES) - set(plans.ORACLE_SQL) == {"d23_spread"}
