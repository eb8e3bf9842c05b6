"""Near-duplicate search reads small tables in few tasks, and leaves only what its result reads."""

import os
import random

from tidemark.llm import common, neardup


def tables(spark):
    top = common.shared_folder(spark).removeprefix("file:")
    return {os.path.join(d, n) for d, names, _ in os.walk(top) for n in names if n.startswith(("table-", "rdd-"))}


def tasks_of(spark, f):
    sc = spark.sparkContext
    sc.setJobGroup("steps", "steps")
    try:
        out = f()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("steps") for s in tracker.getJobInfo(j).stageIds}
    return out, sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x)


def test_components_take_few_tasks(spark):
    rng = random.Random(3)
    pairs = [(10 * g + i, 10 * g + i + 1) for g in range(12) for i in range(rng.randint(1, 8))] + [(500, 500 + i) for i in range(1, 40)] + [(3, 2), (7, 7)]
    want = {}
    for a, b in pairs * 12:
        if a != b:
            want[a] = want[b] = min(want.get(a, a), want.get(b, b))
    links = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    partitions, coalesces = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found, tasks = tasks_of(spark, lambda: neardup.components(links))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesces)
    assert {r.id: r.component for r in found.collect()} == want
    # 420; as row checkpoints with a union in each round 1,188.
    assert 24 < tasks < 600


def test_only_tables_of_the_result_stay(spark):
    rng = random.Random(4)
    # Texts of one template share buckets across components, so all steps run.
    head = [f"h{i}" for i in range(40)]
    docs = [(i, " ".join(head + [f"w{rng.randint(0, 60)}" for _ in range(12)])) for i in range(60)]
    before = tables(spark)
    out = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    # As row checkpoints 14 were left.
    assert len(tables(spark) - before) <= 3
    assert out.count() == 60
