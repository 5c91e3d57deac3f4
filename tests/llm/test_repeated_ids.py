"""An id that stands on unrelated texts."""

from marlstone.llm import simhash


def test_keep_one_of_each_text(spark):
    rows = [(5, "one text of seven words in all"), (5, "and some other text altogether than that"), (5, "one text of seven words in all"), (7, "ONE text of seven words in all")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in kept.collect()) == sorted(rows[:2])
