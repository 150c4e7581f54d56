"""The SQL of protocols that run until few are left plays as many rounds as a large table asks for."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT range AS c_custkey FROM range(600000)")
    return con


def test_champion(con):
    rows = con.execute(entry.oracle_sql()["champion"]).fetchall()
    assert len(rows) == 1 and 18 < rows[0][1] <= 20


def test_exact_target(con):
    assert con.execute(f"SELECT sum(imagescore) FROM ({entry.oracle_sql()['exact_target']})").fetchone()[0] == 100


def test_single_elimination(con):
    sql = entry.oracle_sql()["single_elimination"]
    best = con.execute(f"SELECT imagescore, count(*) FROM ({sql}) GROUP BY 1 ORDER BY 1 DESC LIMIT 2").fetchall()
    assert best == [(20, 1), (19, 1)]
