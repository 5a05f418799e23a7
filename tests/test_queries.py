"""Queries against their SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
NAMES = ("told_nf1", "intern_concept_names", "saturate_all", "direct_parents_of_all", "obo_relationships", "json_terms", "owl_restrictions")


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = entry.queries()[name](spark, str(DATA))
    wanted = con.sql(entry.oracle_sql()[name])
    columns = sorted(wanted.columns)
    assert columns == sorted(found.columns)
    key = lambda rows: sorted((tuple(map(str, r)) for r in rows))
    assert key(found.select(*columns).collect()) == key(wanted.select(*columns).fetchall())


def test_every_query_is_callable():
    assert all(map(callable, entry.queries().values()))
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ("told_supplies", "saturate_whole", "links_of_whole", "obo_xrefs", "nf6_transitive", "classified_records", "stats"))
def test_whole_survey(spark, name):
    test_same_rows(spark, name)


def test_links_of_the_whole_need_no_facts(spark, monkeypatch):
    """No link of the warehouse starts from what other rules add."""
    from subsumer import queries

    seen, plain = [], queries.saturate
    monkeypatch.setattr(queries, "saturate", lambda *a, **k: seen.append(plain(*a, **k)) or seen[-1])
    queries.links_of_whole(spark, str(DATA))
    assert seen[0].rules == {"CR1", "CR3", "CR10", "CR11"}


def test_parts_of_one_small_file_are_parsed_by_many_tasks(spark):
    from subsumer import queries

    assert queries._parts_obo(spark, str(DATA)).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
