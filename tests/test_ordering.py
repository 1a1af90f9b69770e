import random

from pyspark.sql import functions as F

from arborlens.operators import ordering


def test_positions_with_one_hot_key(spark):
    """Half of the rows share a key; they are numbered in many tasks."""
    draw = random.Random(5)
    rows = [("hot" if draw.random() < 0.5 else f"k{draw.randint(0, 30)}", f"v{i:05}", i % 7) for i in range(6000)]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, v string, size int").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        numbered = ordering.number_rows(frame, ["k"], [F.desc("v")], running={"before": "size"})
        got = numbered.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    by_key = {}
    for r in got:
        by_key.setdefault(r.k, []).append(r)
    assert len(got) == 6000
    for key, found in by_key.items():
        found.sort(key=lambda r: r.pos)
        assert [r.v for r in found] == sorted((v for k, v, _ in rows if k == key), reverse=True)
        total = 0
        for n, r in enumerate(found):
            assert (r.pos, r.before) == (n, total)
            total += r.size


def test_no_window_over_a_whole_key(spark):
    frame = spark.createDataFrame([("a", i) for i in range(10)], "k string, v int")
    plan = ordering.number_rows(frame, ["k"], ["v"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 1 and "_task" in windows[0]


def test_global_numbering_and_empty_input(spark):
    frame = spark.range(100).select((F.col("id") * 37 % 100).alias("v"))
    rows = ordering.number_rows(frame, [], ["v"]).collect()
    assert all(r.v == r.pos for r in rows) and len(rows) == 100
    assert ordering.number_rows(frame.where("v < 0"), [], ["v"]).count() == 0
