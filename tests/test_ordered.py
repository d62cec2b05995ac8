"""The split way for hot groups gives the rows of the plain window."""

import random

import pytest
from pyspark.sql import functions as F

from parcelry.operators import budgets, journal
from parcelry.operators.ordered import number_in_group, previous_in_group, running_sum_in_group


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of all rows in one group, a null group, and several small ones."""
    rng = random.Random(3)
    groups = ["hot"] * 600 + [None] * 40 + [f"g{i % 30}" for i in range(560)]
    rows = [(g, rng.randint(0, 400), i, rng.choice(["attempt", "advance"]), rng.choice(["file", "table", "index"])) for i, g in enumerate(groups)]
    return spark.createDataFrame(rows, "job_id string, ts bigint, event_id bigint, kind string, spends string").repartition(8).cache()


ORDER = ["ts", "event_id"]


def same(a, b):
    key = lambda row: str(sorted(row.asDict().items(), key=str))
    left, right = sorted(map(key, a.collect())), sorted(map(key, b.collect()))
    assert left == right and left


def test_number(skewed):
    same(number_in_group(skewed, ["job_id"], ORDER, "n", 10**9), number_in_group(skewed, ["job_id"], ORDER, "n", 100))


def test_number_every_group_split(skewed):
    same(number_in_group(skewed, ["job_id"], ORDER, "n", 10**9), number_in_group(skewed, ["job_id"], ORDER, "n", 0))


def test_running_sums(skewed):
    sums = {"adv": (F.col("kind") == "advance").cast("bigint"), "all": F.lit(1).cast("bigint")}
    for hot in (100, 0):
        same(running_sum_in_group(skewed, ["job_id"], ORDER, sums, 10**9), running_sum_in_group(skewed, ["job_id"], ORDER, sums, hot))


def test_previous(skewed):
    columns = {"before": "kind", "before_ts": "ts"}
    for hot in (100, 0):
        same(previous_in_group(skewed, ["job_id"], ORDER, columns, 10**9), previous_in_group(skewed, ["job_id"], ORDER, columns, hot))


def test_previous_backwards(skewed):
    order, columns = [F.desc("ts"), F.desc("event_id")], {"next_ts": "ts"}
    same(previous_in_group(skewed, ["job_id"], order, columns, 10**9), previous_in_group(skewed, ["job_id"], order, columns, 100))


def test_stalls_budgets_and_transitions(skewed):
    same(journal.stall_runs(skewed, 10**9), journal.stall_runs(skewed, 100))
    same(budgets.stall_budgets(skewed, hot_rows=10**9), budgets.stall_budgets(skewed, hot_rows=100))
    states = skewed.withColumn("state", F.when(F.col("kind") == "advance", "ready").otherwise("running"))
    same(journal.illegal_transitions(states, 10**9), journal.illegal_transitions(states, 100))


def test_whole_table_as_one_group(skewed):
    rows = number_in_group(skewed, [], ORDER, "n").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 1201))
    assert [(r["ts"], r["event_id"]) for r in rows] == sorted((r["ts"], r["event_id"]) for r in rows)


def replay(steps, file_bytes, table_bytes, table_rows):
    """The rule event by event."""
    fruitless, failed = 0, False
    for kind, spends in steps:
        if failed:
            break
        if kind == "advance":
            fruitless = 0
            continue
        if fruitless >= 2:
            if spends == "file" and file_bytes > 1:
                file_bytes //= 2
            elif spends == "table" and (table_bytes > 1 or table_rows > 1):
                table_bytes, table_rows = max(1, table_bytes // 2), max(1, table_rows // 2)
            else:
                failed = True
                break
            fruitless = 0
        fruitless += 1
    return file_bytes, table_bytes, table_rows, failed


@pytest.mark.parametrize("start", [(262144, 4194304, 1000), (5, 9, 3), (1, 1, 1)])
def test_budgets_equal_the_replay(spark, start):
    rng = random.Random(11)
    rows, want = [], {}
    for job in range(40):
        steps = [(rng.choices(["attempt", "advance"], [9, 2])[0], rng.choices(["file", "table", "structure"], [9, 9, 1])[0]) for _ in range(rng.randint(1, 60))]
        rows += [(job, i, i, kind, spends) for i, (kind, spends) in enumerate(steps)]
        want[job] = replay(steps, *start)
    events = spark.createDataFrame(rows, "job_id bigint, ts bigint, event_id bigint, kind string, spends string")
    got = budgets.stall_budgets(events, *start)
    assert {r["job_id"]: (r["file_bytes"], r["table_bytes"], r["table_rows"], r["failed"]) for r in got.collect()} == want
