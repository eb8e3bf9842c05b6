"""Operators of many written steps leave no shuffle files of the finished ones, and the session's setting as it was."""

import pytest

from tidemark.llm import common, lines, neardup


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_")}


@pytest.mark.parametrize("operator", [neardup.near_duplicates, lines.dedup_lines])
def test_finished_steps_leave_no_shuffle_files(spark, operator):
    text = [" ".join(f"w{(i * j) % 7}" for j in range(40)) + "\n" + "\n".join(f"line {j % 3} of all" for j in range(5)) + f"\n{i // 2}" for i in range(24)]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").repartition(3)
    before, setting = shuffle_files(spark), spark.conf.get(common.REMOVES_SHUFFLES, None)
    made = operator(docs)
    # A shuffle of 4 tasks has 12 files; without removal one of these operators left 79 here.
    assert len(shuffle_files(spark) - before) <= 48
    assert spark.conf.get(common.REMOVES_SHUFFLES, None) == setting
    assert made.count() == 24
