"""Token alignment, nearest neighbours and the Merkle manifest against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parcelry.llm import cross_polytope, merkle, token_alignment

FILE_A, FILE_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (None, None), (-1, ""), (-2, " "), (-3, "a\u2581b"), (-4, "  x  y \n\n z\t"), (-5, "<s> </s> <|endoftext|>x <0x41>"), (-6, "\u00e9\u6f22\u5b57 " * 50),
    (-6, "a" * 5000), (-7, "\x00 \x1c b"), (-8, "\u6f22\u5b57\u4eee\u540d" * 400), (-9, "ab\u00a0cd\u3000ef\u2009 "), (None, "don't we're  x  y 12345 ...!!!"),
    (-10, "one \u2581 " + "word " * 900), (-11, "word " * 900 + "one \u2581"),
]


def plain_groups(text, a, b):
    """The groups of one text from both libraries' tokens; none if their bytes do not come back."""
    letters = token_alignment.byte_of_letter()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(letters[x] for x in a.id_to_token(i)) for i in ids_a]
    pieces = [b.id_to_piece(i) for i in ids_b]
    raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("\u2581", " ").encode() for p in pieces]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return []
    ends = [np.cumsum([len(x) for x in raw]) for raw in (raw_a, raw_b)]
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends[0].tolist()) & set(ends[1].tolist())):
        x, y = int(np.searchsorted(ends[0], cut)) + 1, int(np.searchsorted(ends[1], cut)) + 1
        groups.append((ids_a[i:x], ids_b[j:y]))
        i, j = x, y
    return groups


def plain_alignment(rows):
    a, b = Tokenizer.from_file(FILE_A), sentencepiece.SentencePieceProcessor(model_file=FILE_B)
    a.encode_special_tokens = True
    docs = [(i, plain_groups(t, a, b) if t else []) for i, t in rows]
    count = Counter()
    for _, groups in docs:
        count.update({(x, y) for p, q in groups for x in p for y in q})
    most = {}
    for (x, _), n in count.items():
        most[x] = max(n, most.get(x, 0))
    for i, groups in docs:
        links = [(x, y) for p, q in groups for x in p for y in q]
        written = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        yield (
            i, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links), sum(count[x] == most[x[0]] for x in links),
            sum(count[x] for x in links), hashlib.sha256(written.encode()).hexdigest() if groups else "",
        )


@pytest.mark.parametrize(("work", "chunk"), [(1 << 16, 1 << 21), (7, 300)])
def test_alignment_equals_the_libraries(spark, sf, work, chunk):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit("extra")).repartition(3)
    got = token_alignment.aligned_documents(docs, FILE_A, FILE_B, work, chunk).collect()
    assert Counter(tuple(r) for r in got) == Counter(plain_alignment(rows))


@pytest.mark.parametrize(("block", "chunk"), [(200, 3000), (150, 1 << 21)])
def test_blocks_of_a_chunk_equal_the_libraries(spark, sf, monkeypatch, block, chunk):
    monkeypatch.setattr(token_alignment, "BLOCK_CHARS", block)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 = 0").select("doc_id", "text").collect()] + ODD * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = token_alignment.aligned_documents(docs, FILE_A, FILE_B, 50, chunk).collect()
    assert Counter(tuple(r) for r in got) == Counter(plain_alignment(rows))


@pytest.mark.parametrize("texts", [700, 1])
def test_memory_of_a_chunk_is_that_of_a_block(monkeypatch, texts):
    rng = random.Random(texts)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 10))) for _ in range(3000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(texts)), "text": [" ".join(rng.choices(words, k=385_000 // texts)) for _ in range(texts)]})
    monkeypatch.setattr(token_alignment, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = token_alignment.chunk_rows(SimpleNamespace(mapInArrow=lambda run, schema: run), FILE_A, FILE_B)
    assert sum(map(len, batch.column("text").to_pylist())) > token_alignment.CHUNK_CHARS
    token_alignment.worker_pair(FILE_A, FILE_B).forget()
    tracemalloc.start()
    try:
        assert sum(len(made.column("doc_id")[0]) for made in run(iter([batch]))) == texts
        assert tracemalloc.get_traced_memory()[1] < 80e6
    finally:
        tracemalloc.stop()


def test_groups_of_a_text(spark):
    a, b = Tokenizer.from_file(FILE_A), sentencepiece.SentencePieceProcessor(model_file=FILE_B)
    text = "Merge paths: na\u00efve tokens,  twice.\n" * 40
    rows = token_alignment.aligned_groups(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), FILE_A, FILE_B, 5, 100).collect()
    assert [(r["a"], r["b"]) for r in sorted(rows, key=lambda r: r["begin"])] == plain_groups(text, a, b)
    assert {r["doc_id"] for r in rows} == {1} and min(r["begin"] for r in rows) == 0


def test_pieces_of_the_merge_give_all_common_ends():
    rng = random.Random(5)
    for _ in range(200):
        last = rng.randrange(1, 60)
        a, b = (np.array(sorted({last, *rng.sample(range(1, last + 1), rng.randrange(last))})) for _ in range(2))
        common = np.intersect1d(a, b)
        for work in (1, 2, 7, 1000):
            taken_a, taken_b = token_alignment.diagonals(a, b, work)
            assert (np.diff(taken_a) + np.diff(taken_b) <= work).all()
            cut_a, cut_b = token_alignment.aligned(a, b, work)
            assert a[cut_a - 1].tolist() == b[cut_b - 1].tolist() == common.tolist()
            over = set()
            for edge in zip(taken_a, taken_a[1:], taken_b, taken_b[1:], strict=False):
                piece = token_alignment.merged_piece(a, b, *map(int, edge))
                over |= set(zip(piece.over_a.tolist(), piece.over_b.tolist(), strict=True))
            begin = lambda ends, i: int(ends[i - 1]) if i else 0
            want = {(i, j) for i in range(len(a)) for j in range(len(b)) if max(begin(a, i), begin(b, j)) < min(a[i], b[j])}
            if work == 1000:
                assert over == want
            assert want <= over


def clustered(n, seed, size=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    return [(i, (centres[rng.integers(12)] + 0.6 * rng.normal(size=size)).tolist()) for i in range(n)]


def plain_nearest(rows, wanted, k):
    found = {}
    for q, v in rows:
        if q not in wanted:
            continue
        scores = {}
        for i, x in rows:
            if i != q and len(x) == len(v):
                s = sum(a * b for a, b in zip(v, x, strict=True)) / (math.sqrt(sum(a * a for a in v)) * math.sqrt(sum(b * b for b in x)))
                scores[i] = max(s, scores.get(i, -2))
        found[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return found


VECTORS = "vec_id long, embedding array<double>"


def test_neighbours_reach_their_recall_and_are_exact(spark):
    rows = clustered(3000, 1)
    vectors = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = cross_polytope.search(vectors, vectors.where("vec_id % 50 = 0")).collect()
    want = plain_nearest(rows, set(range(0, 3000, 50)), 5)
    hits, by_id = 0, dict(rows)
    for r in got:
        hits += r["vec_id"] in dict(want[r["query_id"]])
        x, y = np.array(by_id[r["query_id"]]), np.array(by_id[r["vec_id"]])
        assert abs(r["score"] - x @ y / np.linalg.norm(x) / np.linalg.norm(y)) < 1e-12
    assert len(got) == 300 and hits >= 0.9 * 300


def test_blocks_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "BLOCK", 7)
    rows = clustered(300, 2) + [(1000 + i, [1.0] * 24) for i in range(120)]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(5)
    exact = cross_polytope.Setting(1, 2, cross_polytope.BUCKETS)
    got = {}
    for r in cross_polytope.search(vectors, vectors.where("vec_id % 50 = 0"), setting=exact).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = plain_nearest(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    assert got == {q: [i for i, _ in x] for q, x in want.items()}


def test_odd_vectors(spark):
    tiny, huge = [1e-320, 0.0, 1e-320], [1e300, 0.0, 1e300]
    rows = [
        (0, [1.0, 0.0, 1.0]), (1, tiny), (2, huge), (3, [0.0, 0.0, 0.0]), (4, None), (5, [1.0, None, 1.0]), (6, [1.0, float("nan"), 1.0]), (7, [1.0, float("inf"), 1.0]),
        (8, [1.0, 0.0]), (9, [-1.0, 0.0, -1.0]), (10, [0.0, 1.0, 0.0]), (10, [1.0, 0.0, 1.1]), (None, [1.0, 0.0, 1.0]), (11, []), (50, [1.0, 0.0]), (100, [5.0]),
    ]
    vectors = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("extra"))
    got = cross_polytope.search(vectors, vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 10), (0, 4, 9), (50, 1, 8)]
    assert [round(r["score"], 3) for r in got] == [1.0, 1.0, 0.999, -1.0, 1.0]


def test_a_setting_that_finds_too_few_looks_everywhere(spark):
    rows = clustered(400, 3)
    vectors = spark.createDataFrame(rows, VECTORS)
    got = cross_polytope.search(vectors, vectors.where("vec_id % 50 = 0"), k=40, setting=cross_polytope.Setting(2, 2, 1)).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {i: 40 for i in range(0, 400, 50)}


def test_rotations_keep_lengths():
    x = np.random.default_rng(1).normal(size=(50, 24))
    assert np.allclose(np.linalg.norm(cross_polytope.rotated(x, 0, 0, 1), axis=1), np.linalg.norm(x, axis=1))


ROWS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows):
    """For each row, in order of source and doc_id: leaf, subroot, root, digest of the siblings, and the root folded from the altered leaf."""

    def grow(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            run = i // 16 * 16
            yield level[run:i], level[i + 1 : run + 16]
            i //= 16

    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        leaves = [(r, digest(*map(plain_field, r))) for r in by_source[name]]
        leaves.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append((leaves, grow([x for _, x in leaves])))
    top = grow([levels[-1][0] for _, levels in trees])
    for k, (leaves, levels) in enumerate(trees):
        for i, (r, leaf) in enumerate(leaves):
            siblings = [*path(levels, i), *path(top, k)]
            altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            now = digest(*map(plain_field, (*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])))) if altered else leaf
            for before, after in siblings:
                now = digest(*before, now, *after)
            root = top[-1][0]
            yield r[0], leaf, levels[-1][0], root, digest(*(x for before, after in siblings for x in (*before, *after))), now, now == root


@pytest.mark.parametrize("block", [4096, 5])
def test_manifest_equals_a_plain_one(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rng = random.Random(block)
    rows = [(i, rng.choice(["big", "big", "big", "S\u00e9", "s", None, f"own{i % 40}"]), rng.choice(["en", None]), rng.choice([None, 3]), f"Text {i}") for i in range(700)]
    rows += [(None, "big", None, None, None), (None, None, None, None, None), (5, "big", "en", 1, "Twin"), (5, "big", "en", 1, "Twin"), (15, "lone", "", -1, "")]
    docs = spark.createDataFrame(rows, ROWS).withColumn("leaf", F.lit("extra")).repartition(4)
    got = merkle.proofs(merkle.manifest(docs, merkle.lowered_text(docs))).collect()
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r[c] for c in names) for r in got) == Counter(plain_manifest(rows))
    assert all(digest(*r["proof"]) == r["proof_sha256"] for r in got)
    assert not all(r["verified"] for r in got)


def test_proofs_of_some_rows_equal_those_of_all(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tree = merkle.manifest(docs)
    some = docs.where("doc_id % 7 = 3").select("doc_id")
    every = {r["doc_id"]: r for r in merkle.proofs(tree, whole=False).collect()}
    rows = merkle.proofs(tree, some, whole=False).collect()
    assert len(rows) == some.count() and all(r == every[r["doc_id"]] and r["verified"] for r in rows)


def test_the_nodes_asked_for_are_the_least():
    assert merkle.missing(np.arange(16), 16) == []
    assert merkle.missing(np.array([0]), 1) == []
    assert merkle.missing(np.array([3]), 5) == [(0, 0), (0, 1), (0, 2), (0, 4)]
    assert merkle.missing(np.arange(16, 32), 33) == [(1, 0), (1, 2)]


def test_tables_of_one_row_and_one_source(spark):
    one = merkle.proofs(merkle.manifest(spark.createDataFrame([(1, None, "en", 1, "x")], ROWS))).collect()
    assert one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["proof"] == [] and one[0]["verified"]
