"""Messages of groups as a stream: any batches give the batch result once."""

import random

import pytest

from memlake.operators.memory import turn_triggers
from memlake.streaming.groups import turn_stream
from memlake.streaming.incremental import run_to_table, table_stream

SCHEMA = "conv string, turn long"


def run(spark, tmp_path, name="a", files=1):
    source = table_stream(spark, f"{tmp_path}/in", SCHEMA, files)
    run_to_table(turn_stream(source, "conv", "turn", 3), f"{tmp_path}/out-{name}", f"{tmp_path}/mark-{name}").awaitTermination()
    rows = spark.read.schema("conv string, first long, last long, messages long, turn_no long").parquet(f"{tmp_path}/out-{name}")
    return sorted(map(tuple, rows.collect()))


def want(spark, rows):
    df = spark.createDataFrame(sorted(set(rows)), SCHEMA)
    turns = {}
    for c, t in sorted(set(rows)):
        turns.setdefault(c, []).append(t)
    return sorted((r.conv, turns[r.conv][r.turn_no - 3], r.turn, 3, r.turn_no) for r in turn_triggers(df, "conv", "turn", 3).collect())


@pytest.mark.parametrize("batches", [1, 4])
def test_any_batches_give_the_batch_result(spark, tmp_path, batches):
    r = random.Random(batches)
    rows = [(f"c{c}", 2 * t) for c in range(5) for t in range(c * 3 + 1)]
    odd = [(None, 1), ("c1", None)]
    cuts = [[] for _ in range(batches)]
    for c in range(5):
        own = [x for x in rows if x[0] == f"c{c}"]
        at = sorted(r.randrange(len(own) + 1) for _ in range(batches - 1))
        for k, (a, b) in enumerate(zip([0, *at], [*at, len(own)])):
            cuts[k] += own[max(0, a - 2) : b]  # the last two are sent again
    for k, part in enumerate(cuts):
        spark.createDataFrame(part + odd, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k == batches // 2:  # stopped and started again
            run(spark, tmp_path)
    got = run(spark, tmp_path)
    assert got == want(spark, rows) == run(spark, tmp_path)
