"""A benchmark without any word matches nothing."""

import pytest

from wakeline.llm import decontaminate


@pytest.mark.parametrize("items", [[], [(1, ""), (2, " \n"), (3, None)]])
def test_no_match(spark, items):
    docs = spark.createDataFrame([(1, "some words of a text that is long enough"), (2, ""), (3, None)], "doc_id long, text string")
    assert decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect() == []
