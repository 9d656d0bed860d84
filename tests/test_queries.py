import pytest
from .conftest import DATA, same_rows

import __spark_entry__ as entry
from patchloom.plans import queries as Q

#: Queries that find too little, or nothing, on the smallest tables.
LARGER = ("end_to_end", "removed_line_rule", "streamed_scores")


@pytest.mark.parametrize("name", sorted(set(Q.SQL) - set(LARGER)))
def test_query_matches_its_sql(spark, duck, name):
    rows = Q.QUERIES[name](spark, DATA).toPandas()
    assert len(rows)
    same_rows(rows, duck.execute(Q.SQL[name]).df())


@pytest.mark.parametrize("name", LARGER)
def test_query_matches_its_sql_on_larger_tables(spark, name):
    import duckdb

    at = DATA.replace("0.001", "0.01")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{at}/documents.parquet')")
    rows = Q.QUERIES[name](spark, at).toPandas()
    assert len(rows)
    same_rows(rows, con.execute(Q.SQL[name]).df())


def test_the_catalogue_meets_almost_every_rule(spark):
    found = {r["rule_id"] for r in Q.QUERIES["catalogue_cases"](spark, DATA).select("rule_id").distinct().collect()}
    assert len(found) >= 80


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() == 10 and {"total", "band"} <= set(rows.columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())
