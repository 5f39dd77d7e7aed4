"""Every registered query against its SQL, or for rows where SQL has no form."""

import __spark_entry__ as entry
import compare
import pytest

from corpusloom.plans import corpus_queries

NAMES = list(corpus_queries.QUERIES)


@pytest.mark.parametrize("name", [n for n in NAMES if n in corpus_queries.ORACLE_SQL])
def test_equals_sql(spark, data, name):
    assert compare.difference(spark, entry, name, f"{data}/sf0.01") is None


@pytest.mark.parametrize("name", [n for n in NAMES if n not in corpus_queries.ORACLE_SQL])
def test_has_rows(spark, data, name):
    assert corpus_queries.QUERIES[name](spark, f"{data}/sf0.001").count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
