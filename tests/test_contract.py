"""The driver contract, and the SQL comparison of a few queries on the small tables."""

import pytest

import __spark_entry__ as entry_point
import check


def test_names_agree():
    queries, oracles = entry_point.queries(), entry_point.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 75
    # The training-data operators are registered together, or not at all when their subpackage is absent.
    assert len([n for n in queries if n.startswith("op") or n == "pipeline"]) in (0, 14)


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["dataset", "n_blocks", "n_inputs", "n_padding"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["extract_conversation", "dedupe_prefix", "multi_dataset_pack", "manifest", "scan_text_paragraphs"])
def test_query_equals_sql(spark, sf, name):
    assert check.compare(spark, sf, [name]) == 0
