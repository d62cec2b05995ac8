"""Whole extractions, from the checks to the audit entry."""

import hashlib
import os

import pytest

from parcelry.operators.segments import reassemble
from parcelry.plans.extraction import Request, SelectionRefused, Source, extract
from parcelry.sources.audit_log import read_audit

FILES = ["a/1.bin", "a.txt", "z/empty", "b/2.bin"]


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("site")
    for i, name in enumerate(FILES):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if "empty" in name else os.urandom(300 + i))
    sources = {
        "t": Source(spark.range(0, 230).selectExpr("id", "concat('v', id) as v"), ["id"]),
        "log": Source(spark.range(0, 20).selectExpr("id % 3 as n", "id as x"), order=["n", "x"]),
        "bare": Source(spark.range(5).toDF("k"), ["k"]),
    }
    return str(root), sources


def test_extract_and_reassemble(spark, site, tmp_path):
    root, sources = site
    request = Request(7, ["t", "log"], ["bare"], FILES, part_bytes=100, slice_rows=100, user_login="me")
    got = extract(spark, request, sources, str(tmp_path / "out"), root, str(tmp_path / "log"))
    rows = got.orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(len(rows)))
    assert [r["name"] for r in rows] == ["t"] * 3 + ["log", "bare"] + ["a/1.bin"] * 3 + ["a.txt"] * 4 + ["z/empty"] + ["b/2.bin"] * 4
    whole = {r["name"]: bytes(r["payload"]) for r in reassemble(got).collect()}
    for name in FILES:
        with open(os.path.join(root, name), "rb") as handle:
            assert whole[name] == handle.read()
    assert whole["t"].count(b"INSERT INTO") == 3 and whole["t"].count(b"CREATE TABLE") == 1
    assert b"INSERT" not in whole["bare"] and b"CREATE TABLE `bare`" in whole["bare"]
    entry = read_audit(spark, str(tmp_path / "log")).first()
    assert (entry["tables"], entry["tables_structure_only"], entry["user_login"]) == (["t", "log"], ["bare"], "me")
    assert entry["files"]["count"] == 4 and entry["files"]["roots"] == ["a", "a.txt", "b", "z"]
    assert entry["files"]["sha256"] == hashlib.sha256("\n".join(sorted(FILES)).encode()).hexdigest()


@pytest.mark.parametrize(
    "request_, verdict, names",
    [
        (Request(1), "malformed", []),
        (Request(1, ["t", "t"]), "malformed", []),
        (Request(1, ["t"], ["t"]), "overlap", ["t"]),
        (Request(1, ["nope", "t"], files=["gone", "../x"]), "unknown", ["../x", "gone", "nope"]),
        (Request(1, ["nope"], files=["a/.env", "a.txt"]), "restricted", ["a/.env"]),
        (Request(1, ["t"], part_bytes=0), "bad_size", []),
    ],
)
def test_refusals_name_every_offender(spark, site, tmp_path, request_, verdict, names):
    root, sources = site
    with pytest.raises(SelectionRefused) as refused:
        extract(spark, request_, sources, str(tmp_path / "out"), root)
    assert (refused.value.verdict, refused.value.names) == (verdict, names)
    assert not (tmp_path / "out").exists()


def test_a_lenient_request_skips_and_reports(spark, site, tmp_path):
    root, sources = site
    request = Request(2, files=["gone", "a.txt"], strict=False)
    got = extract(spark, request, sources, str(tmp_path / "out"), root)
    assert [r["name"] for r in got.collect()] == ["a.txt"]
    assert request.skipped == ["gone"]


def test_files_that_go_between_listing_and_reading(spark, site, tmp_path, monkeypatch):
    from parcelry.plans import extraction

    root, sources = site
    passing = os.path.join(root, "m.gone")
    real = extraction._chosen_files

    def lists_then_deletes(rows, manifest):
        os.remove(passing)
        return real(rows, manifest)

    monkeypatch.setattr(extraction, "_chosen_files", lists_then_deletes)
    names = ["a.txt", "m.gone", "never", "z/empty"]
    for strict in (False, True):
        with open(passing, "wb") as handle:
            handle.write(bytes(250))
        request = Request(4, ["bare"], files=names if not strict else ["a.txt", "m.gone"], strict=strict, part_bytes=100)
        if strict:
            with pytest.raises(Exception, match="No such file"):
                extract(spark, request, sources, str(tmp_path / "strict"), root)
            continue
        rows = extract(spark, request, sources, str(tmp_path / "out"), root, str(tmp_path / "log")).orderBy("seq").collect()
        assert request.skipped == ["never", "m.gone"]
        assert [r["seq"] for r in rows] == list(range(len(rows))) and {r["name"] for r in rows} == {"bare", "a.txt", "z/empty"}
        assert read_audit(spark, str(tmp_path / "log")).first()["files"]["count"] == 2


def test_a_link_out_of_the_root_is_out_of_bounds(spark, site, tmp_path):
    root, sources = site
    (tmp_path / "secret").write_bytes(b"x")
    links = {"out.link": tmp_path / "secret", "in.link": os.path.join(root, "a.txt")}
    for name, target in links.items():
        os.symlink(target, os.path.join(root, name))
    try:
        got = extract(spark, Request(5, files=["in.link"], strict=False), sources, str(tmp_path / "in"), root).collect()
        assert {r["name"] for r in got} == {"in.link"}
        with pytest.raises(SelectionRefused) as refused:
            extract(spark, Request(5, files=["out.link", "a.txt"], strict=False), sources, str(tmp_path / "out"), root)
        assert (refused.value.verdict, refused.value.names) == ("unknown", ["out.link"])
    finally:
        for name in links:
            os.remove(os.path.join(root, name))


def test_nothing_staged_is_left_behind(spark, site, tmp_path):
    from parcelry.session import scratch_root

    staged = os.path.join(scratch_root(spark), "parcelry")
    before = set(os.listdir(staged)) if os.path.isdir(staged) else set()
    root, sources = site
    extract(spark, Request(3, ["t"], files=FILES), sources, str(tmp_path / "out"), root)
    assert set(os.listdir(staged)) == before
