"""Every registered query with SQL gives what DuckDB gives on the smallest tables."""

import duckdb
import pytest

from reelgrid.plans import catalog
from tests.conftest import SF001

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return con


def plain(rows, at):
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF001)
    want = con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    assert plain(df.collect(), [df.columns.index(n) for n in order]) == plain(want.fetchall(), [names.index(n) for n in order])


def test_number_list_on_odd_vectors(spark, tmp_path):
    """Products in single precision, as in DuckDB (0.29 gives 29), and lists with nulls, of nulls alone, empty and null."""
    path = str(tmp_path / "embeddings.parquet")
    rows = [(i, v, i % 3) for i, v in enumerate([[0.29, 0.57, -0.29], [1.0, None, 2.0], [None], [None, None], [], None, [-0.0, -1e-30, 9.2e16, -9.2e16]])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(f"SELECT vec_id, label, listed FROM ({catalog.oracle_sql()['fn09_number_list']})").fetchall()
    got = catalog.queries()["fn09_number_list"](spark, str(tmp_path)).select("vec_id", "label", "listed").collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and sorted(want)[0][2] == "29,57,-29"


@pytest.mark.parametrize("value", [float("nan"), float("inf"), 1e17])
def test_number_list_of_no_number_is_an_error(spark, tmp_path, value):
    spark.createDataFrame([(1, [value], 0)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    with pytest.raises(Exception, match="not a 64-bit number"):
        catalog.queries()["fn09_number_list"](spark, str(tmp_path)).collect()
