"""Every registered query with an oracle statement equals DuckDB on the sf0.001 tables."""

import os
import sys

import pytest

from conftest import SF001

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check_oracle import compare, duck  # noqa: E402
from lexiframe.plans import catalog  # noqa: E402
from lexiframe.plans.oracle import oracle_sql as catalog_sql  # noqa: E402

NAMES = sorted(oracle_sql())


def test_every_query_registered():
    """All queries of the library have an oracle but those that train 30,000 entries, or encode with a vocabulary
    that SQL does not have; ``test_bpe.py`` compares these with the tokenizer library."""
    qs = catalog.queries()
    assert set(oracle_sql()) <= set(queries()) and set(qs) <= set(queries())
    assert set(qs) - set(catalog_sql()) == {"bpe_vocab", "bpe_encode", "bpe_lm_batches", "bpe_of_files",
                                            "web_supplied_batches"}


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["word", "n"] and df.count() > 0


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = queries()[name](spark, SF001).toPandas()
    want = con.execute(oracle_sql()[name]).df()
    assert compare(got, want) == "OK"
