from __future__ import annotations

import time

from listenlake.llm import common
from listenlake.llm.components import _star, components


def shuffle_files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum("shuffle_" in found.apply(i).getName() for i in range(found.length()))


def test_storing_small_tables_lets_go_of_shuffles_again_and_again(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "released", calls.append)
    for k in range(2 * common.RELEASE_EVERY):
        common.checkpointed(spark.range(k))
    assert calls == [spark] * 2


def test_shuffle_files_of_finished_steps_go(spark):
    dealt = spark.range(0, 1000, 1, 8).repartition(8, "id")
    assert dealt.count() == 1000
    made = shuffle_files(spark)
    del dealt
    for _ in range(20):
        common.released(spark)
        if shuffle_files(spark) < made:
            break
        time.sleep(0.2)
    assert shuffle_files(spark) < made


def test_workers_give_back_what_a_task_has_freed(spark):
    """Many small pieces between others are kept by the allocator until it is told to give them back."""

    def anonymous():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("Anonymous:")) // 1024

    def over(batches):
        held = [bytes(1000) for _ in range(200_000)]
        last = [bytes(1000) for _ in range(100)]  # lies behind them, so that the heap does not shrink by itself
        held.clear()
        keep.append(last)
        yield from batches

    keep, found = [], []
    for run in (over, common.lean(over)):
        before = anonymous()
        list(run(iter([1])))
        found.append(anonymous() - before)
    assert found[1] < 100, found
    rows = spark.range(10).mapInArrow(common.lean(lambda batches: batches), "id bigint")
    assert sorted(r["id"] for r in rows.collect()) == list(range(10))


def test_small_tables_are_grouped_and_joined_in_one_task(spark):
    """Rounds over few links leave no shuffle, whatever Spark takes their size for."""
    common.with_code(spark)
    links = common.checkpointed(spark.range(1, 200, 1, 8).selectExpr("id AS a", "id - 1 AS b"))
    now = common.gathered(links, 199)
    assert now.rdd.getNumPartitions() == 1
    assert common.gathered(links, 3 * common.TASK_ROWS + 1).rdd.getNumPartitions() == 4
    for larger_only in (True, False):
        now = _star(now, larger_only)
        assert "Exchange hashpartitioning" not in now._jdf.queryExecution().executedPlan().toString()
    found = components(links)
    assert found.count() == 200 and {r["component"] for r in found.collect()} == {0}
