"""Selection checks, audit log and job rules on small hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from parcelry.operators import journal, paging, selection, telemetry
from parcelry.sources import audit_log
from parcelry.sources.audit_log import AUDIT_SCHEMA, append_audit, read_audit, rotate_audit
from parcelry.sources.samples import read_samples

NOW = 1_706_659_200


def requests(spark, cases):
    entries, heads = [], []
    for job, (items, strict, size, _) in enumerate(cases):
        heads.append((job, strict, size))
        entries += [(job, kind, i, name) for i, (kind, name) in enumerate(items)]
    return (
        spark.createDataFrame(heads, "job_id int, strict string, chunk_size string"),
        spark.createDataFrame(entries, "job_id int, kind string, ordinal int, name string"),
    )


T, S, X = "table", "structure", "file"
CASES = [
    ([(T, "t1"), (X, "a/b")], None, None, "ok"),
    ([(S, "t1")], "true", "1", "ok"),
    ([], None, None, "malformed"),
    ([(T, "")], None, None, "malformed"),
    ([(T, None)], None, None, "malformed"),
    ([("view", "t1")], None, None, "malformed"),
    ([(T, "t1"), (T, "t1")], None, None, "malformed"),
    ([(T, "t1"), (T, "t2"), (X, "a/b"), (X, "c")], "maybe", "0", "too_large"),
    ([(T, "t1"), (S, "t1")], "maybe", None, "overlap"),
    ([(T, "t1")], "maybe", "0", "bad_flag"),
    ([(T, "t1")], None, "0", "bad_size"),
    ([(T, "t1")], None, "1.5", "bad_size"),
    ([(T, "gone"), (X, ".env")], None, None, "restricted"),
    ([(T, "gone")], "false", None, "unknown"),
    ([(X, "nope")], None, None, "unknown"),
    ([(X, "nope")], "false", None, "unknown"),
    ([(X, "nope"), (X, "a/b")], "false", None, "ok"),
    ([(X, "nope"), (T, "t1")], "false", None, "ok"),
    ([(X, "x/../a/b"), (X, "a/b")], "false", None, "unknown"),
    ([(X, "./a//b"), (X, "t1")], "false", None, "ok"),
    ([(X, "a/b"), (T, "a/b")], None, None, "unknown"),
]


def test_verdicts(spark):
    heads, entries = requests(spark, CASES)
    catalog = spark.createDataFrame([("t1",), ("t2",)], "name string")
    manifest = spark.createDataFrame([("a/b", 1), ("c", 1)], "path string, size int")
    got = selection.selection_verdict(heads, entries, catalog, manifest, cap=3)
    assert [r["verdict"] for r in got.orderBy("job_id").collect()] == [verdict for *_, verdict in CASES]


def test_tasks_of_verdicts_grow_with_the_entries(spark, monkeypatch):
    monkeypatch.setattr(selection, "ENTRIES_PER_TASK", 100)
    cases = [([(T, "t1")], None, None, "ok"), ([(X, f"a/{i}") for i in range(2900)], None, None, "unknown"), ([(X, "a/0"), (X, "a/0")], None, None, "malformed")]
    heads, entries = requests(spark, cases)
    catalog = spark.createDataFrame([("t1",)], "name string")
    manifest = spark.createDataFrame([("a/0", 1)], "path string, size int")
    got = selection.selection_verdict(heads, entries, catalog, manifest)
    assert [(r["entries"], r["verdict"]) for r in got.orderBy("job_id").collect()] == [(len(c[0]), c[-1]) for c in cases]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 30), REPARTITION_BY_NUM") >= 2


def test_skips_and_missing(spark):
    heads, entries = requests(spark, [([(X, "nope"), (X, "../x"), (T, "gone"), (X, "a/b")], flag, None, "") for flag in ("false", "true")])
    catalog = spark.createDataFrame([("t1",)], "name string")
    manifest = spark.createDataFrame([("a/b", 1)], "path string, size int")
    assert [(r["job_id"], r["name"]) for r in selection.skip_report(entries, manifest, heads).collect()] == [(0, "nope")]
    gone = selection.all_missing(entries, catalog, manifest).filter("job_id = 0").orderBy("ordinal").collect()
    assert [(r["name"], r["reason"]) for r in gone] == [("nope", "vanished"), ("../x", "out_of_bounds"), ("gone", "no_table")]


def entry(seq, ts, job=1):
    return {"ts": ts, "seq": seq, "user_id": 1, "user_login": "ü", "api_version": 7, "job_id": job, "tables": ["t"], "tables_structure_only": [], "files": {"count": 1, "bytes": 2, "roots": ["a"], "sha256": "x"}}


def test_audit_log_drops_unreadable_lines(spark, tmp_path):
    day = tmp_path / "log" / "day=2024-01-30"
    day.mkdir(parents=True)
    lines = [json.dumps(entry(1, NOW - 86400)), "{broken", "[1,2]", '"text"', "", json.dumps(entry(2, NOW - 80000)), json.dumps({**entry(3, 1), "ts": "soon"})]
    (day / "a.json").write_text("\n".join(lines) + "\n")
    rows = read_audit(spark, str(tmp_path / "log"))
    assert sorted(r["seq"] for r in rows.collect()) == [1, 2]
    new = spark.createDataFrame([entry(4, NOW)], rows.drop("day").schema)
    append_audit(new, str(tmp_path / "log"))
    again = read_audit(spark, str(tmp_path / "log")).orderBy("seq").collect()
    assert [r["seq"] for r in again] == [1, 2, 4]
    assert again[2].asDict(recursive=True)["files"] == {"count": 1, "bytes": 2, "roots": ["a"], "sha256": "x"}
    plan = paging.day_window(read_audit(spark, str(tmp_path / "log")), "2024-01-31", None)
    assert [r["seq"] for r in plan.collect()] == [4]
    assert "day" in plan._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1].split("]")[0]


@pytest.fixture(scope="module")
def log(spark):
    """Ties, several days, and one entry without a readable time."""
    rows = [(i, None if i == 7 else NOW - (i // 4) * 30_000) for i in range(60)]
    return spark.createDataFrame(rows, "seq bigint, ts bigint").repartition(4).cache()


def test_audit_pages(log):
    want = sorted(((r["ts"], r["seq"]) for r in log.collect() if r["ts"] is not None), key=lambda e: (-e[0], e[1]))
    walked = []
    for page in range(1, 9):
        rows = paging.audit_page(log, page, 8).collect()
        assert {r["total"] for r in rows} <= {59}
        walked += [r["seq"] for r in rows]
    assert walked == [seq for _, seq in want]
    assert paging.audit_page(log, 99, 8).count() == 0
    assert paging.audit_page(log, 0, 0).count() == 1
    assert paging.audit_page(log, 1, 500).count() == 59
    third, beyond = paging.audit_listing(log, 3, 8).first(), paging.audit_listing(log, 99, 8).first()
    assert [e["seq"] for e in third["entries"]] == [seq for _, seq in want[16:24]] and third["total"] == 59
    assert (beyond["entries"], beyond["total"], beyond["page"], beyond["per_page"]) == ([], 59, 99, 8)


def test_day_windows(log):
    ts = {r["seq"]: r["ts"] for r in log.collect()}
    low, high = NOW - 2 * 86400, NOW
    assert {r["seq"] for r in paging.day_window(log, "2024-01-29", "2024-01-30").collect()} == {s for s, t in ts.items() if t is not None and low <= t < high}
    assert paging.day_window(log, None, None).count() == 59
    with pytest.raises(ValueError):
        paging.day_window(log, "yesterday", None)


def test_rotation_of_the_stored_log(spark, tmp_path, monkeypatch):
    path, day = str(tmp_path / "log"), 86400
    stamps = [None, *[NOW - i * day // 4 for i in range(40)]]
    entries = spark.createDataFrame([{**entry(i, ts)} for i, ts in enumerate(stamps)], AUDIT_SCHEMA)
    append_audit(entries, path)
    now = NOW + day // 3
    want = {i for i, ts in enumerate(stamps) if ts is not None and ts > now - 5 * day}

    # The first rotation dies once its rewrite is committed; an entry is appended before the next one ends it.
    real, calls = audit_log._end_rotations, []

    def dies(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        real(*args)

    monkeypatch.setattr(audit_log, "_end_rotations", dies)
    with pytest.raises(RuntimeError, match="killed"):
        rotate_audit(spark, path, now, 5)
    assert {r["seq"] for r in read_audit(spark, path).collect()} >= want
    edge = now - 5 * day
    append_audit(spark.createDataFrame([entry(99, edge + 1)], AUDIT_SCHEMA), path)
    for _ in range(2):
        rotate_audit(spark, path, now, 5)
        assert sorted(r["seq"] for r in read_audit(spark, path).collect()) == sorted(want | {99})
    rotate_audit(spark, path, now + 100 * day, 5)
    assert not (tmp_path / "log").exists()
    rotate_audit(spark, path, now, 5)


def test_retention(log):
    kept = {r["seq"] for r in journal.retain(log, NOW, 1).collect()}
    assert kept == {r["seq"] for r in log.collect() if r["ts"] is not None and r["ts"] > NOW - 86400}
    assert journal.retain(log, NOW, 0).count() == 0


def test_expiry_and_advance(spark):
    rows = [
        (1, "running", NOW - 100, NOW - 100, None), (2, "running", NOW - 9000, NOW - 3601, NOW - 3601), (3, "ready", NOW - 9000, NOW - 3600, None),
        (4, "failed", NOW - 9000, NOW - 4000, None), (5, "consumed", 0, 0, None), (6, "running", NOW - 21_601, NOW, None),
        (7, "running", NOW - 90_000, NOW, NOW - 21_600), (8, "queued", NOW, NOW, None), (9, "running", NOW - 500, NOW - 120, None), (10, "running", NOW - 500, NOW - 121, None),
    ]
    df = spark.createDataFrame(rows, "job_id int, state string, created_at bigint, updated_at bigint, progressed_at bigint")
    assert sorted(r["job_id"] for r in journal.expired(df, NOW).collect()) == [2, 4, 6]
    assert sorted(r["job_id"] for r in journal.needs_advance(df, NOW).collect()) == [2, 8, 10]


def test_orphans_need_shape_age_and_no_owner(spark):
    good = "ab" * 16
    rows = [(f"{good}.sealed", 0), ("cd" * 16 + ".sealed", 0), (f"{good[:-1]}.sealed", 0), (f"{good.upper()}.sealed", 0), ("ef" * 16 + ".sealed", NOW - 3600)]
    files = spark.createDataFrame(rows, "artifact string, mtime bigint")
    claimed = spark.createDataFrame([("cd" * 16 + ".sealed",)], "artifact string")
    assert [r["artifact"] for r in journal.orphans(files, claimed, NOW).collect()] == [f"{good}.sealed"]


def test_list_jobs_hides_finished_work(spark):
    rows = [(1, 5, "running", 0, 0, 3), (2, 5, "failed", 0, 0, 4), (3, 6, "running", 0, 0, 5)]
    df = spark.createDataFrame(rows, "job_id int, owner int, state string, created_at int, updated_at int, files_done int")
    own = spark.createDataFrame([(5,)], "owner int")
    assert [r["job_id"] for r in journal.list_jobs(df, own).collect()] == [1]
    everything = journal.list_jobs(df, own, include_terminal=True).orderBy("job_id").collect()
    assert [(r["job_id"], r["files_done"]) for r in everything] == [(1, 3), (2, None)]


def test_phases_accumulate(spark):
    rows = [(1, {"seal": 5, "read": 2, "total": 10}), (1, {"seal": 4, "total": 6, "save": 1}), (2, {"read": 1})]
    df = spark.createDataFrame(rows, "job_id int, phases map<string,bigint>")
    got = {r["job_id"]: (r["seal"], r["read"], r["save"], r["total"], r["unattributed"]) for r in telemetry.phase_totals(df).collect()}
    assert got == {1: (9, 2, 1, 16, 4), 2: (0, 1, 0, 0, -1)}


def test_samples_to_telemetry(spark, tmp_path):
    head = "epoch,iso,state,tables_done,tables_total,files_done,files_total,chunks_done,http"
    steps = [(0, 0), (15, 1), (30, 3), (45, 3), (130, 3), (145, 4), (300, 4)]
    for run in ("a", "b"):
        (tmp_path / run).mkdir()
        body = [f'"{1000 + t}","x","running",0,0,0,1,{c},"200"' for t, c in steps]
        (tmp_path / run / "s.csv").write_text("\n".join([head, *body]) + "\n")
    samples = read_samples(spark, str(tmp_path)).withColumn("chunk_size", F.lit(2097152))
    assert samples.count() == 14
    costs = telemetry.cost_per_part(samples).orderBy("series").collect()
    assert [(r["series"], r["wall_s"], r["parts"], r["s_per_part"]) for r in costs] == [("a", 300, 4, 75.0), ("b", 300, 4, 75.0)]
    pause = telemetry.pause_share(samples).filter("series = 'a'").first()
    assert (pause["paused_s"], pause["elapsed_s"]) == (115 + 155, 300)


def test_best_rate_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"s{i % 5}", rng.randint(-3000, 9000), rng.randint(1, 4)) for i in range(800)]
    df = spark.createDataFrame(rows, "series string, epoch bigint, units bigint")
    want = {}
    for series in {s for s, *_ in rows}:
        mine = [(t, u) for s, t, u in rows if s == series]
        want[series] = max(sum(u for t, u in mine if end - 600 < t <= end) for end, _ in mine)
    assert {r["series"]: r["best_units"] for r in telemetry.best_rate(df).collect()} == want
