"""Trees, manifest pages, parts, digests and pins."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from parcelry.functions.cursors import decode_cursor
from parcelry.operators import manifest as files
from parcelry.operators import segments
from parcelry.sources.files import file_manifest, read_parts
from parcelry.sources.segment_store import read_segments, write_segments
from parcelry.sources.tables import structure_segments, table_catalog

LISTED = [".dot", "07", "log/2024/june", "log/2024/may", "log/last", "log.old", "log0", "x y", "é"]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for i, name in enumerate(LISTED):
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(os.urandom(i * 37))
    (root / "empty").mkdir()
    (root / "loop").symlink_to(root)
    (root / "_underscored").mkdir()
    return root


@pytest.fixture(scope="module")
def listing(spark, tree):
    return file_manifest(spark, str(tree)).cache()


def test_tree_scan(listing, tree):
    rows = {r["path"]: r for r in listing.collect()}
    assert sorted(rows) == sorted(LISTED)
    for name in LISTED:
        facts = (tree / name).stat()
        assert (rows[name]["size"], rows[name]["mtime"]) == (facts.st_size, int(facts.st_mtime))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 100])
def test_pages_walk_the_canonical_order(spark, listing, n):
    pages = files.path_pages(listing, n).orderBy("page").collect()
    assert [p["cursor"] is None for p in pages] == [False] * (len(pages) - 1) + [True]
    assert sum(p["files"] for p in pages) == len(LISTED)
    after, walked = None, []
    for page in pages:
        walked += [r["path"] for r in files.manifest_page(listing, after, n).collect()]
        if page["cursor"]:
            path = spark.range(1).select(decode_cursor(F.lit(page["cursor"]))).first()[0]
            after = path.split("/")
    assert walked == LISTED


def test_parts_read_back_whole(listing, tree):
    parts = read_parts(listing, str(tree), 50)
    whole = segments.reassemble(parts.select(F.col("path").alias("name"), F.col("offset").alias("seq"), "payload"))
    got = {r["name"]: bytes(r["payload"]) for r in whole.collect()}
    assert got == {name: (tree / name).read_bytes() for name in LISTED}
    empty = parts.filter("path = '.dot'").collect()
    assert [(r["offset"], r["length"], r["done"]) for r in empty] == [(0, 0, True)]


def test_changed_file_fails_the_read(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"one")
    stale = spark.createDataFrame([("f", 4, 0)], "path string, size bigint, mtime bigint")
    with pytest.raises(Exception, match="changed while it was being packaged"):
        read_parts(stale, str(tmp_path)).collect()


def test_outside_and_torn_files_fail_the_read(spark, tmp_path):
    import os as system

    from parcelry.sources import files as sources

    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "big").write_bytes(bytes(30))
    (tmp_path / "outer").write_bytes(b"x")
    system.symlink(tmp_path / "outer", tmp_path / "root" / "link")
    tree = sources.scan_tree(spark, str(tmp_path / "root"))
    assert {r["path"]: r["inside"] for r in tree.files.collect()} == {"big": True, "link": False}
    with pytest.raises(Exception, match="resolves outside the root"):
        read_parts(tree.files.filter("path = 'link'"), str(tmp_path / "root")).collect()
    listed = tree.files.filter("path = 'big'").collect()
    both = spark.createDataFrame([*listed, ("gone", 25, 0, True)], tree.files.schema)
    parts, gone = sources.read_present_parts(both, str(tmp_path / "root"), 10)
    assert parts.count() == 3 and [r["path"] for r in gone.collect()] == ["gone"]


def test_unreadable_directories_are_reported(tmp_path):
    import pandas as pd

    from parcelry.sources.files import _list_directories

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f").write_bytes(b"abc")
    found = pd.concat(_list_directories(str(tmp_path), iter([pd.DataFrame({"path": ["gone", "d"]})])))
    assert [tuple(r) for r in found[["path", "kind", "size"]].itertuples(index=False)] == [("gone", "unreadable", 0), ("d/f", "file", 3)]


@pytest.mark.parametrize("size, chunk, want", [(0, 10, [(0, 0, True)]), (10, 10, [(0, 10, True)]), (25, 10, [(0, 10, False), (10, 10, False), (20, 5, True)])])
def test_part_bounds(spark, size, chunk, want):
    df = spark.createDataFrame([("p", bytes(range(size)))], "path string, content binary")
    rows = segments.file_parts(df, chunk).orderBy("offset").collect()
    assert [(r["offset"], r["length"], r["done"]) for r in rows] == want
    assert b"".join(bytes(r["payload"]) for r in rows) == bytes(range(size))


RECIPE = [
    ("single", b"only"), ("t", b"part 1;"), ("t", b"part 2;"), ("t", b"part 3;"), ("empty.txt", b""),
    ("binär-ファイル.bin", bytes(range(256))), ("same-a", b"SAME"), ("same-b", b"SAME"),
]


@pytest.fixture(scope="module")
def recipe(spark):
    rows = [("art", i, name, payload) for i, (name, payload) in enumerate(RECIPE)]
    return spark.createDataFrame(rows, "artifact string, seq bigint, name string, payload binary").repartition(4).cache()


def whole_of(df):
    out = {}
    for row in df.orderBy("name", "part").collect():
        out[row["name"]] = out.get(row["name"], b"") + bytes(row["payload"])
    return out


@pytest.mark.parametrize("cell", [1 << 20, 20, 0])
def test_reassembly_with_and_without_a_size_limit(recipe, cell):
    want = {}
    for name, payload in RECIPE:
        want[name] = want.get(name, b"") + payload
    assert whole_of(segments.reassemble(recipe, cell_bytes=cell)) == want


def test_store_outline_and_pairing(spark, recipe, tmp_path):
    write_segments(recipe, str(tmp_path / "s"))
    outline = {(r["level"], r["name"]): r for r in segments.artifact_outline(read_segments(spark, str(tmp_path / "s"))).collect()}
    assert (outline["artifact", None]["segments"], outline["artifact", None]["bytes"]) == (8, sum(len(p) for _, p in RECIPE))
    assert (outline["name", "t"]["segments"], outline["name", "t"]["largest"]) == (3, 7)
    with pytest.raises(Exception, match="(?i)already exists"):
        write_segments(recipe, str(tmp_path / "s"))
    short = recipe.filter("seq <> 3").select("artifact", "seq", "name")
    paired = segments.pair_names(short, recipe)
    assert [(r["seq"], r["status"]) for r in paired.filter("status <> 'paired'").collect()] == [(3, "no_name")]


def test_nothing_unpublished_is_read(spark, recipe, tmp_path):
    from parcelry.sources.segment_store import NotPublished

    path = str(tmp_path / "s")
    broken = recipe.withColumn("payload", F.when(F.col("seq") == 5, F.raise_error(F.lit("killed")).cast("binary")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="killed"):
        write_segments(broken.repartition(4), path)
    recipe.select("artifact", "seq", "name", "payload").write.parquet(f"{path}/_data/unended")  # a writer still at work
    with pytest.raises(NotPublished):
        read_segments(spark, path)
    (tmp_path / "s" / "_published").write_text("unended\n")  # its last line is missing
    with pytest.raises(NotPublished):
        read_segments(spark, path)
    (tmp_path / "s" / "_published").unlink()
    (tmp_path / "s" / "._published.crc").unlink(missing_ok=True)
    write_segments(recipe, path)
    assert read_segments(spark, path).count() == recipe.count()


def test_build_order(spark):
    rows = [(1, "file", 0, 0), (1, "table", 1, 1), (1, "structure", 0, 0), (1, "table", 1, 0), (1, "table", 0, 0), (2, "file", 0, 0)]
    df = spark.createDataFrame(rows, "job_id int, kind string, ordinal int, part int")
    got = {(r["job_id"], r["kind"], r["ordinal"], r["part"]): r["seq"] for r in segments.segment_order(df).collect()}
    assert got == {(1, "table", 0, 0): 0, (1, "table", 1, 0): 1, (1, "table", 1, 1): 2, (1, "structure", 0, 0): 3, (1, "file", 0, 0): 4, (2, "file", 0, 0): 0}


def test_digests(spark):
    paths = [f"r{i % 3}/f{i:04d}é" for i in range(120)]
    rows = [("big", p, 10) for p in paths] + [("small", "x", 1), ("small", "a/b", 2), (None, "n", 3), ("none", None, 4)]
    df = spark.createDataFrame(rows, "site string, path string, size bigint").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # lists go on over many batches
    try:
        got = {r["site"]: r for r in files.files_digest(df, "site").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got["big"]["sha256"] == hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()
    assert (got["small"]["files"], got["small"]["bytes"], got["small"]["roots"]) == (2, 3, "a,x")
    assert got[None]["sha256"] == hashlib.sha256(b"n").hexdigest() and got["none"]["sha256"] is None


def test_tree_digest_merges(spark):
    paths = [f"r{i % 3}/f{i:04d}" for i in range(120)] + ["x"]
    df = spark.createDataFrame([("big", p) for p in paths] + [("small", "a/b")], "site string, path string")
    ranges = files.range_digests(df, "site")
    want = []
    for name in ("r0", "r1", "r2", "x"):
        own = sorted(p for p in paths if p.split("/")[0] == name)
        want.append(f"{name}\t{len(own)}\t{hashlib.sha256(chr(10).join(own).encode()).hexdigest()}")
    got = {r["site"]: r for r in files.tree_digest(ranges, "site").collect()}
    assert got["big"]["sha256"] == hashlib.sha256("\n".join(want).encode()).hexdigest() and (got["big"]["files"], got["big"]["ranges"]) == (121, 4)
    one, rest = (files.range_digests(df.filter(c), "site") for c in ("path LIKE 'r1/%'", "path NOT LIKE 'r1/%'"))
    merged = {r["site"]: r["sha256"] for r in files.tree_digest(one.unionByName(rest), "site").collect()}
    assert merged == {site: r["sha256"] for site, r in got.items()}


def test_version_pins(spark):
    rows = [
        ("ok", 1, True, 5, 1), ("ok", 2, True, 5, 1), ("size", 1, True, 5, 1), ("size", 2, True, 6, 1), ("time", 1, True, 5, 1),
        ("time", 2, True, 5, 2), ("late", 1, True, 5, 1), ("late", 2, False, None, None), ("early", 1, False, None, None),
        ("never", 1, False, None, None), ("early", 2, True, 5, 1),
    ]
    df = spark.createDataFrame(rows, "path string, at int, present boolean, size bigint, mtime bigint")
    got = {r["path"]: r["verdict"] for r in files.version_pin(df).collect()}
    assert got == {"ok": "pinned", "size": "changed", "time": "changed", "late": "vanished", "early": "skipped", "never": "skipped"}


def test_catalog(spark, sf):
    paths = {name: f"{sf}/{name}.parquet" for name in ("orders", "nation")}
    rows = {r["name"]: r for r in table_catalog(spark, paths, {"orders": "7", "nation": "0"}).collect()}
    assert (rows["orders"]["rows"], rows["nation"]["rows"]) == (7, 25)
    assert {n: r["bytes"] for n, r in rows.items()} == {n: os.path.getsize(p) for n, p in paths.items()}


def test_structure_only(spark, sf):
    row = structure_segments({"nation": spark.read.parquet(f"{sf}/nation.parquet")}).first()
    assert bytes(row["payload"]).decode().splitlines()[4:7] == ["DROP TABLE IF EXISTS `nation`;", "CREATE TABLE `nation` (", "  `n_nationkey` INT,"]
