"""Streams: stopped, crashed and restarted runs end where one batch run ends."""

import pytest
from pyspark.sql import functions as F

from parcelry.operators import budgets, journal
from parcelry.operators.segments import table_segments
from parcelry.operators.slicing import slice_table
from parcelry.sources.audit_log import AUDIT_SCHEMA, read_audit
from parcelry.streaming import extract as extract_module
from parcelry.streaming.adapt import advise_stream, latest_advice
from parcelry.streaming.audit import audit_stream, late_entries, settle_audit
from parcelry.streaming.extract import extract_stream, read_extracted
from parcelry.streaming.monitor import ALERT_SCHEMA, late_rows, monitor_stream, standing_alerts

ONE_FILE = {"maxFilesPerTrigger": "1"}


def add_file(df, folder, name):
    """Adds one file to a stream's folder; names fix the order in which they are read."""
    import os
    import time

    path = folder / f"{name}.parquet"
    df.toPandas().to_parquet(path, coerce_timestamps="us", index=False)
    os.utime(path, (time.time(), 1_700_000_000 + int(name)))


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).options(**ONE_FILE).parquet(str(folder))


def tuples_in(payloads):
    text = b"".join(payloads).decode()
    body = "".join(line for line in text.splitlines(keepends=True) if line.startswith("INSERT"))
    return body.replace("INSERT INTO `t` VALUES ", ",").replace(";\n", "").lstrip(",")


def test_extraction_survives_a_crash(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    source.mkdir()
    df = spark.range(0, 1000).select("id", F.concat(F.lit("v"), "id").alias("v"))
    for i in range(4):
        add_file(df.filter((F.col("id") >= i * 250) & (F.col("id") < (i + 1) * 250)), source, str(i))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    real, crashed = extract_module.write_batch, []

    def dies_after_writing(batch, path, batch_id):
        real(batch, path, batch_id)
        if batch_id == 2 and not crashed:
            crashed.append(batch_id)
            raise RuntimeError("killed before the commit")

    monkeypatch.setattr(extract_module, "write_batch", dies_after_writing)
    stream = stream_of(spark, source, df.schema)
    with pytest.raises(Exception, match="killed before the commit"):
        extract_stream(stream, "t", ["id"], out, checkpoint, max_rows=100).awaitTermination()
    extract_stream(stream_of(spark, source, df.schema), "t", ["id"], out, checkpoint, max_rows=100).awaitTermination()
    assert crashed == [2]

    extract_module.finish_extract(spark, df.schema, "t", ["id"], out, max_rows=100)
    got = read_extracted(spark, out).orderBy("batch", "part").collect()
    assert {r["batch"] for r in got} == {0, 1, 2, 3, 4}
    assert [(r["part"], bytes(r["payload"])) for r in got] == whole_segments(spark.read.parquet(str(source)), ["id"], 100)


def whole_segments(df, key, max_rows, max_bytes=1 << 30):
    prefix = extract_module.structure_text("t", df.schema) + extract_module.data_header("t")
    rows = table_segments(slice_table(df, key, max_rows, max_bytes), "t", df.columns, prefix).orderBy("part").collect()
    return [(r["part"], bytes(r["payload"])) for r in rows]


@pytest.mark.parametrize(("max_rows", "max_bytes"), [(1000, 700), (100, 1 << 30)])
def test_extraction_from_many_files_equals_one_cut(spark, tmp_path, max_rows, max_bytes):
    source = tmp_path / "in"
    source.mkdir()
    df = spark.range(0, 900).select("id", F.expr("repeat('x', cast(id % 50 as int))").alias("v"))
    edges = [0, 3, 300, 640, 900]
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        add_file(df.filter((F.col("id") >= low) & (F.col("id") < high)), source, str(i))
    out, limits = str(tmp_path / "out"), {"max_rows": max_rows, "max_bytes": max_bytes}
    extract_stream(stream_of(spark, source, df.schema), "t", ["id"], out, str(tmp_path / "cp"), **limits).awaitTermination()
    extract_module.finish_extract(spark, df.schema, "t", ["id"], out, **limits)
    got = [(r["part"], bytes(r["payload"])) for r in read_extracted(spark, out).orderBy("part").collect()]
    assert got == whole_segments(spark.read.parquet(str(source)), ["id"], max_rows, max_bytes)


def test_extraction_refuses_keys_that_go_back(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    df = spark.range(0, 100).select("id")
    for i, low in enumerate((50, 0)):
        add_file(df.filter((F.col("id") >= low) & (F.col("id") < low + 50)), source, str(i))
    with pytest.raises(Exception, match="not behind"):
        extract_stream(stream_of(spark, source, df.schema), "t", ["id"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()


STEPS = "job_id bigint, ts bigint, event_id bigint, kind string, spends string"


def test_advice_carries_over_restarts(spark, tmp_path):
    import random

    rng = random.Random(2)
    rows = [(rng.randint(1, 6), i, i, rng.choices(["attempt", "advance"], [5, 1])[0], rng.choice(["file", "table"])) for i in range(300)]
    source = tmp_path / "in"
    source.mkdir()
    whole = spark.createDataFrame(rows, STEPS)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for i in range(3):
        add_file(whole.filter((F.col("ts") >= i * 100) & (F.col("ts") < i * 100 + 100)), source, str(i))
        advise_stream(stream_of(spark, source, whole.schema), out, checkpoint, table_rows=6).awaitTermination()
    got = {r["job_id"]: tuple(r) for r in latest_advice(spark, out).collect()}
    want = {r["job_id"]: tuple(r) for r in budgets.stall_budgets(whole, table_rows=6).collect()}
    assert got == want


def test_carried_folds_equal_one_fold(spark):
    import random

    rng = random.Random(4)
    kinds, spent = ["attempt", "advance"], ["file", "table", "file", "table", "index"]
    rows = [(rng.randint(1, 25), i, i, rng.choices(kinds, [6, 1])[0], rng.choices(spent, [9, 9, 9, 9, 1])[0]) for i in range(900)]
    whole = spark.createDataFrame(rows, STEPS)
    for limit, hot in ((1, 2_000_000), (2, 2_000_000), (3, 10)):
        start, folded = budgets.Budgets(16, 64, 4, limit), None
        for low in range(0, 900, 300):
            part = whole.filter((F.col("ts") >= low) & (F.col("ts") < low + 300))
            before = folded if folded is not None else spark.createDataFrame([], "job_id bigint, fruitless int, files bigint, tables bigint, failed boolean")
            rows_of = budgets.fold_stalls(part, start, before, hot).select("job_id", "fruitless", "files", "tables", "failed").collect()
            folded = spark.createDataFrame(rows_of, "job_id bigint, fruitless int, files bigint, tables bigint, failed boolean")
        got = {r["job_id"]: tuple(r) for r in start.advice(folded).collect()}
        assert got == {r["job_id"]: tuple(r) for r in budgets.stall_budgets(whole, 16, 64, 4, limit).collect()}


def test_advice_of_shuffled_files_is_that_of_the_journal(spark, tmp_path):
    import random

    rng = random.Random(5)
    rows = [(rng.randint(1, 12), rng.randrange(20_000), i, rng.choices(["attempt", "advance"], [6, 1])[0], rng.choice(["file", "table"])) for i in range(560)]
    source = tmp_path / "in"
    source.mkdir()
    whole = spark.createDataFrame(rows, STEPS)
    for i in range(140):
        add_file(spark.createDataFrame(rows[i * 4 : i * 4 + 4], STEPS), source, f"{i:03d}")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", "35").parquet(str(source))
    out = str(tmp_path / "out")
    advise_stream(stream, out, str(tmp_path / "cp"), table_rows=6).awaitTermination()
    got = {r["job_id"]: tuple(r) for r in latest_advice(spark, out).collect()}
    assert got == {r["job_id"]: tuple(r) for r in budgets.stall_budgets(whole, table_rows=6).collect()}


EVENTS = "job_id bigint, ts bigint, event_id bigint, kind string, state string"
BASE = 1_700_000_000


def test_monitor_raises_each_alert_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    first = [(1, BASE, 1, "advance", "running"), (2, BASE, 2, "other", "ready"), (3, BASE + 10, 3, "other", "failed"), (9, BASE + 20, 4, "other", "running")]
    beat = [(9, BASE + 1500, 5, "advance", "running"), (1, BASE + 1500, 6, "other", "running")]
    late = [(1, BASE + 30, 7, "advance", "running"), (9, BASE + 6000, 8, "advance", "running")]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for i, rows in enumerate([first, beat, late]):
        add_file(spark.createDataFrame(rows, EVENTS), source, str(i))
        stream = stream_of(spark, source, spark.createDataFrame([], EVENTS).schema)
        monitor_stream(stream, out, checkpoint).awaitTermination()
    alerts = spark.read.schema(f"{ALERT_SCHEMA}, batch bigint").option("basePath", out).parquet(out).collect()
    got = sorted((r["job_id"], r["alert"], r["state"], r["due_at"]) for r in alerts)
    # The watermark ends at 6000 - 600 s; job 9 beat at 6000 and is live, jobs 1 to 3 went silent.
    assert [g for g in got if g[1] == "expired"] == [
        (1, "expired", "running", BASE + 1500 + 3601), (2, "expired", "ready", BASE + 3601), (3, "expired", "failed", BASE + 10 + 3601),
    ]
    assert {g[0] for g in got if g[1] == "stale"} <= {1, 9}
    assert len(got) == len(set(got))
    records = spark.createDataFrame([(1, "running", BASE, BASE + 1500, BASE), (9, "running", BASE + 20, BASE + 6000, BASE + 6000)],
                                    "job_id int, state string, created_at bigint, updated_at bigint, progressed_at bigint")
    assert [r["job_id"] for r in journal.expired(records, BASE + 5400).collect()] == [1]
    assert [(r["job_id"], r["ts"]) for r in late_rows(spark, out).collect()] == [(1, BASE + 30)]


def test_monitor_revokes_what_late_rows_disprove(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    batches = [
        [(1, BASE, 1, "advance", "running"), (2, BASE + 9000, 2, "advance", "running")],
        [(1, BASE + 8000, 3, "other", "running"), (3, BASE + 100, 4, "other", "failed")],
    ]
    for i, rows in enumerate(batches):
        add_file(spark.createDataFrame(rows, EVENTS), source, str(i))
    out = str(tmp_path / "out")
    monitor_stream(stream_of(spark, source, spark.createDataFrame([], EVENTS).schema), out, str(tmp_path / "cp")).awaitTermination()
    alerts = spark.read.schema(f"{ALERT_SCHEMA}, batch bigint").option("basePath", out).parquet(out).collect()
    got = {(r["batch"], r["job_id"], r["alert"], r["due_at"] - BASE, r["revoked"]) for r in alerts}
    assert got == {
        (0, 1, "stale", 121, False), (0, 1, "expired", 3601, False), (1, 1, "stale", 121, True), (1, 1, "expired", 3601, True),
        (1, 1, "stale", 8121, False), (1, 3, "expired", 3701, False),
    }
    assert {(r["job_id"], r["alert"]) for r in standing_alerts(spark, out).collect()} == {(1, "stale"), (3, "expired")}
    assert {r["job_id"] for r in late_rows(spark, out).collect()} == {1, 3}


def test_expiry_of_shuffled_files_is_that_of_the_journal(spark, tmp_path):
    import random

    rng = random.Random(12)
    source = tmp_path / "in"
    source.mkdir()
    rows = [(rng.randrange(60), BASE + rng.randrange(90_000), i, rng.choice(["advance", "other"]), rng.choice(["queued", "running", "ready", "failed"]))
            for i in range(420)]
    for i in range(140):
        pd_rows = spark.createDataFrame(rows[i * 3 : i * 3 + 3], EVENTS)
        add_file(pd_rows, source, f"{i:03d}")
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(pd_rows.schema).option("maxFilesPerTrigger", "35").parquet(str(source))
    monitor_stream(stream, out, str(tmp_path / "cp")).awaitTermination()
    whole = spark.createDataFrame(rows, EVENTS)
    records = whole.groupBy("job_id").agg(
        F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
        F.max(F.when(F.col("kind") == "advance", F.col("ts"))).alias("progressed_at"),
    )
    now = max(r[1] for r in rows) - 600
    for alert, judge in (("expired", journal.expired), ("stale", journal.needs_advance)):
        want = {(r["job_id"], r["updated_at"]) for r in judge(records, now).collect()}
        if alert == "stale":  # a queued job newer than the mark is not yet due
            want = {w for w in want if w[1] < now}
        got = standing_alerts(spark, out).filter(F.col("alert") == alert).collect()
        assert {(r["job_id"], r["updated_at"]) for r in got} == want and len(got) == len(want)


def ready_rows(spark, jobs):
    rows = [(BASE + seq, seq, 1, "u", 7, job, ["t"], ["s"], (1, 2, ["a"], "x")) for seq, job in jobs]
    return spark.createDataFrame(rows, AUDIT_SCHEMA)


def test_audit_is_exactly_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out = str(tmp_path / "log")
    batches = [[(1, 10), (2, 11), (3, 10)], [(4, 11), (5, 12)], [(90_000, 10), (90_001, 13)]]
    for i, jobs in enumerate(batches):
        add_file(ready_rows(spark, jobs), source, str(i))
        audit_stream(stream_of(spark, source, AUDIT_SCHEMA), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["job_id"] for r in read_audit(spark, out).collect()) == [10, 11, 12]
    settle_audit(spark, out, str(tmp_path / "cp"))
    want = {10: 1, 11: 2, 12: 5, 13: 90_001}
    assert sorted((r["job_id"], r["seq"]) for r in read_audit(spark, out).collect()) == sorted(want.items())
    # Even a lost checkpoint, which replays everything, adds nothing.
    audit_stream(stream_of(spark, source, AUDIT_SCHEMA), out, str(tmp_path / "cp2")).awaitTermination()
    settle_audit(spark, out, str(tmp_path / "cp2"))
    assert sorted((r["job_id"], r["seq"]) for r in read_audit(spark, out).collect()) == sorted(want.items())


def test_audit_takes_the_earliest_event_in_any_order(spark, tmp_path):
    import random

    rng = random.Random(6)
    source = tmp_path / "in"
    source.mkdir()
    events = [(seq, rng.randrange(25)) for seq in rng.sample(range(500_000), 120)]
    for i in range(3):
        add_file(ready_rows(spark, events[i * 40 : i * 40 + 40]), source, str(i))
    out, checkpoint = str(tmp_path / "log"), str(tmp_path / "cp")
    audit_stream(stream_of(spark, source, AUDIT_SCHEMA), out, checkpoint, hold=None).awaitTermination()
    settle_audit(spark, out, checkpoint)
    want = {}
    for seq, job in events:
        want[job] = min(seq, want.get(job, seq))
    assert sorted((r["job_id"], r["seq"]) for r in read_audit(spark, out).collect()) == sorted(want.items())
    assert late_entries(spark, out, checkpoint).count() == 0


def test_audit_lists_what_came_too_late(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out, checkpoint = str(tmp_path / "log"), str(tmp_path / "cp")
    for i, jobs in enumerate([[(1000, 1)], [(9000, 2)], [(5, 1)]]):
        add_file(ready_rows(spark, jobs), source, str(i))
    audit_stream(stream_of(spark, source, AUDIT_SCHEMA), out, checkpoint).awaitTermination()
    assert [(r["job_id"], r["seq"]) for r in read_audit(spark, out).collect()] == [(1, 1000)]
    assert [(r["job_id"], r["seq"]) for r in late_entries(spark, out, checkpoint).collect()] == [(1, 5)]
