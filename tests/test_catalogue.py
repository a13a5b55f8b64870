import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    value = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(str(value(v)) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, db, name):
    ours, theirs = entry.queries()[name](spark, SF).toPandas(), db.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    number = [c for c in ours.columns if ours[c].dtype.kind in "if" and theirs[c].dtype.kind in "if"]
    ours[number], theirs[number] = ours[number].astype(float), theirs[number].astype(float)
    assert plain(ours) == plain(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_nothing_in_the_library_imports_the_corpus_operators():
    from pathlib import Path

    import inkgauge

    for p in Path(inkgauge.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
