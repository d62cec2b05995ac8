"""Slicing against the row-by-row rule it replaces."""

import random

import pytest
from pyspark.sql import functions as F

from parcelry.functions.literals import row_tuple
from parcelry.operators.numbering import KeyNotUnique, number_keyed, number_rows, number_stored
from parcelry.operators.paging import after_key, keyset_pages, page_after, page_offset, page_offset_by
from parcelry.operators.segments import table_segments
from parcelry.operators.slicing import cut_slices, effective_limit, slice_summary, slice_table


def fold(sizes, limit, budget):
    """The rule itself: (slice, row_in_slice) of every row, one after the other."""
    out, number, place, used = [], 0, 0, 0
    for size in sizes:
        place, used = place + 1, used + size
        out.append((number, place))
        if used >= budget or place == limit:
            number, place, used = number + 1, 0, 0
    return out


def sliced_as_list(spark, sizes, max_rows, max_bytes, block_rows):
    rows = spark.createDataFrame([(i + 1, s) for i, s in enumerate(sizes)], "rn bigint, row_bytes bigint")
    sliced = cut_slices(rows, len(sizes), max_rows, max_bytes, block_rows)
    got = [(r["slice"], r["row_in_slice"]) for r in sliced.rows.orderBy("rn").collect()]
    return got, sliced


@pytest.mark.parametrize("seed", range(12))
def test_blocks_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    limit = rng.choice([1, 2, 3, 7, 20, 100, 130])
    n = rng.randint(1, 900)
    shape = rng.choice(["even", "mixed", "fat tail"])
    sizes = [
        {"even": 10, "mixed": rng.randint(1, 60), "fat tail": 1 if i < n // 2 else rng.randint(40, 90)}[shape]
        for i in range(n)
    ]
    budget = rng.randint(1, 400)
    # Tiny blocks, so slices cross block ends and, with few groups, several blocks chain.
    got, sliced = sliced_as_list(spark, sizes, limit, budget, block_rows=effective_limit(limit))
    want = fold(sizes, effective_limit(limit), budget)
    assert got == want
    assert sliced.count == want[-1][0] + 1
    assert sliced.last_rows == want[-1][1]


def test_many_blocks_chain_through_groups(spark, monkeypatch):
    from parcelry.operators import slicing

    monkeypatch.setattr(slicing, "DRIVER_CELLS", 30)
    sizes = [random.Random(1).randint(1, 9) for _ in range(400)]
    got, _ = sliced_as_list(spark, sizes, 10, 25, block_rows=10)
    assert got == fold(sizes, 10, 25)


def test_the_cut_restarts_after_each_slice(spark):
    got, _ = sliced_as_list(spark, [4, 4, 4, 4, 4], 10, 5, block_rows=10)
    assert [s for s, _ in got] == [0, 0, 1, 1, 2]


def test_row_limit_rounds_down_to_whole_statements():
    assert [effective_limit(n) for n in (0, 1, 99, 100, 199, 250, 1000)] == [1, 1, 99, 100, 100, 200, 1000]


def keyed(spark, n):
    notes = [None, "", "O'Brien", "back\\slash", "a\nb", "ünï😀", "0123"]
    return spark.createDataFrame([(i, f"t{i}", notes[i % 7]) for i in range(n)], "id bigint, tag string, note string")


@pytest.mark.parametrize("n, rows, complete", [(0, [0], [True]), (250, [100, 100, 50], [False, False, True]), (200, [100, 100, 0], [False, False, True])])
def test_end_of_table(spark, n, rows, complete):
    summary = slice_summary(slice_table(keyed(spark, n), ["id"], 150), ["id"]).orderBy("slice").collect()
    assert [r["rows"] for r in summary] == rows
    assert [r["complete"] for r in summary] == complete


def test_a_byte_cut_is_not_the_end(spark):
    wide = spark.createDataFrame([(i, "x" * 50_000) for i in range(20)], "id bigint, payload string")
    summary = slice_summary(slice_table(wide, ["id"], 1000, 204_800), ["id"]).orderBy("slice").collect()
    assert [r["rows"] for r in summary] == [5, 5, 5, 5]
    assert [r["complete"] for r in summary] == [False, False, False, True]
    assert [(r["first_id"], r["last_id"]) for r in summary] == [(0, 4), (5, 9), (10, 14), (15, 19)]


def test_one_row_over_budget_still_advances(spark):
    got, _ = sliced_as_list(spark, [500, 500, 500], 100, 1, block_rows=100)
    assert got == [(0, 1), (1, 1), (2, 1)]


def test_cut_columns_do_not_change_with_what_is_kept(spark):
    df = keyed(spark, 300)
    full = slice_table(df, ["id"], 100, 1500).rows.select("id", "slice", "row_in_slice")
    narrow = slice_table(df, ["id"], 100, 1500, keep=["id"]).rows.select("id", "slice", "row_in_slice")
    assert sorted(full.collect()) == sorted(narrow.collect())


def test_chunked_dump_equals_whole_dump(spark):
    df = keyed(spark, 730)

    def dump(max_rows):
        sliced = slice_table(df, ["id"], max_rows)
        parts = table_segments(sliced, "t", df.columns, "HEAD;\n").orderBy("part").collect()
        return b"".join(bytes(r["payload"]) for r in parts), len(parts)

    (small, many), (large, one) = dump(100), dump(100_000)
    assert small == large
    assert (many, one) == (8, 1)
    assert small.startswith(b"HEAD;\nINSERT INTO `t` VALUES ('0','t0',NULL),('1','t1',''),('2','t2','O\\'Brien')")
    assert small.count(b"INSERT INTO") == 8


def test_reload_equals_original(spark):
    df = keyed(spark, 250)
    parts = table_segments(slice_table(df, ["id"], 100), "t", df.columns, "").orderBy("part").collect()
    text = b"".join(bytes(r["payload"]) for r in parts).decode()
    assert sorted(parse_rows(text), key=lambda r: int(r[0])) == [
        tuple(None if v is None else str(v) for v in row) for row in df.orderBy("id").collect()
    ]


def parse_rows(text):
    """Reads the dump back: tuples of quoted, escaped values."""
    unescape = {"0": "\0", "n": "\n", "r": "\r", "Z": "\x1a"}
    rows, row, value, i = [], [], None, 0
    while i < len(text):
        c = text[i]
        if value is not None:
            if c == "\\":
                i += 1
                value += unescape.get(text[i], text[i])
            elif c == "'":
                row.append(value)
                value = None
            else:
                value += c
        elif c == "'":
            value = ""
        elif text.startswith("NULL", i):
            row.append(None)
            i += 3
        elif c == "(":
            row = []
        elif c == ")":
            rows.append(tuple(row))
        i += 1
    return rows


def test_numbers_are_gap_free_and_ordered(spark):
    df = spark.range(0, 10_000).select((F.col("id") * 7919 % 10_007).alias("k")).repartition(16)
    rows, total = number_keyed(df, ["k"])
    got = [(r["rn"], r["k"]) for r in rows.orderBy("rn").collect()]
    assert total == 10_000
    assert [rn for rn, _ in got] == list(range(1, 10_001))
    assert [k for _, k in got] == sorted(k for _, k in got)


@pytest.mark.parametrize("values", [[1, 2, 2, 3], [1, None, 3]])
def test_a_bad_key_is_refused(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "k bigint")
    with pytest.raises(KeyNotUnique):
        number_keyed(df, ["k"])


def test_lineitem_has_no_key(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    with pytest.raises(KeyNotUnique):
        number_keyed(lines, ["l_orderkey", "l_linenumber"])


def composite(spark):
    """13 values of b per a, so a 100-row cut falls inside a group."""
    return spark.createDataFrame([(i // 13, i % 13, f"x{i}") for i in range(250)], "a bigint, b bigint, tag string")


def test_composite_walk_meets_every_key_once(spark):
    df, cursor, seen = composite(spark).cache(), None, []
    while True:
        page = page_after(df, ["a", "b"], cursor, 100).collect()
        seen += [(r["a"], r["b"]) for r in page]
        if len(page) < 100:
            break
        cursor = [page[-1]["a"], page[-1]["b"]]
    assert seen == [(i // 13, i % 13) for i in range(250)]
    pages = keyset_pages(df, ["a", "b"], 100).orderBy("page").collect()
    assert [(r["rows"], r["last_a"], r["last_b"]) for r in pages] == [(100, 7, 8), (100, 15, 4), (50, 19, 2)]


def test_cursor_predicate_reaches_the_scan(spark, sf):
    talks = spark.read.parquet(f"{sf}/conversations.parquet")
    plan = talks.filter(after_key(["conv_id", "turn"], [3, 1]))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(conv_id,3)" in plan


def test_cursor_arity_is_checked():
    with pytest.raises(ValueError):
        after_key(["a", "b"], [1])


def test_offset_pages_cover_a_keyless_table(spark, tmp_path):
    spark.range(0, 1000, 1, 4).select((F.col("id") % 5).alias("v"), F.col("id").alias("n")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    walked = [r["n"] for start in range(0, 1100, 130) for r in page_offset(df, start, 130).collect()]
    assert sorted(walked) == list(range(1000))
    numbered, total = number_stored(df)
    assert total == 1000
    assert sorted(r["rn"] for r in numbered.collect()) == list(range(1, 1001))
    window = {r["n"] for r in numbered.filter("rn > 130 and rn <= 260").collect()}
    assert window == {r["n"] for r in page_offset(df, 130, 130).collect()}


def test_far_pages_equal_near_pages(spark, monkeypatch):
    from parcelry.operators import paging

    df = spark.range(0, 500).select((F.col("id") * 37 % 503).alias("k"))
    near = [r["k"] for r in page_offset_by(df, ["k"], 200, 50).orderBy("k").collect()]
    monkeypatch.setattr(paging, "TOP_K_ROWS", 10)
    far = [r["k"] for r in page_offset_by(df, ["k"], 200, 50).orderBy("k").collect()]
    assert near == far and len(far) == 50


def test_numbers_follow_descending_order(spark):
    rows, _ = number_rows(spark.range(100), [F.desc("id")])
    assert {r["id"]: r["rn"] for r in rows.collect()} == {i: 100 - i for i in range(100)}


def test_sizes_are_rendered_bytes(spark):
    odd = "cast(if(id % 3 = 0, null, {}) as {}) as {}"
    df = keyed(spark, 50).selectExpr(
        "*", odd.format("id * 1.5 - 20", "double", "d"), odd.format("'2024-01-02 03:04:05.6'", "timestamp", "t"),
        odd.format("'2024-01-02'", "date", "day"), odd.format("id > 5", "boolean", "b"), odd.format("note", "binary", "raw"),
    )
    rows = slice_table(df, ["id"], 100).rows
    wrong = rows.filter(F.col("row_bytes") != F.octet_length(row_tuple(df)) + 1)
    assert wrong.count() == 0
