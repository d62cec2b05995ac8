"""Merkle manifest of a dataset, with inclusion proofs by one multiproof for each partition of leaves.

A leaf is the hash of a row's fields. The leaves of a source, in the order of ``doc_id``, form a tree of ``FAN``
children a node; the subroots of all sources, in the order of the source, form the tree above them. A node's
place is (tree, level, index); tree -1 stands above the others.

- **Numbering.** Leaves are range-partitioned and sorted once, written, and counted inside their partitions;
  what a partition hands to the next is one row each, so a source of any size is never gathered.
- **Levels.** Each level is one grouping by parent, at most ``FAN`` children a group.
- **Proofs.** Leaves lie in blocks of ``BLOCK`` consecutive ones. A block knows its own leaves; climbing level by
  level it finds the least set of nodes that it can neither hold nor derive, fetches each of them once (one join
  for all blocks), derives all interior nodes above its leaves, and expands the proof of every leaf locally. A
  node that thousands of proofs share is sent to a block once.

Results by case: a null field is ``-`` in the leaf; null sources come first, and so do null ids; rows that repeat a
``doc_id`` follow each other in the order of their leaves; equal rows are leaves of their own; a source of one row
has its leaf as subroot, and a table of one source has that subroot as root; an empty table has no rows and no
root; texts of any length are hashed where they are; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.llm.common import shuffle_width, stage

FAN = 16
#: Leaves of a block, at most; a block is what one multiproof covers.
BLOCK = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1
HEX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    as_text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(as_text).cast("string"), F.lit(":"), as_text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


@dataclass(frozen=True)
class Manifest:
    """``leaves``: block, tree, pos, doc_id, source, leaf, altered. ``nodes``: tree, level, idx, digest (those of
    the top tree included). ``sizes``: tree, n. ``trees``: how many sources there are."""

    leaves: DataFrame
    nodes: DataFrame
    sizes: DataFrame
    trees: int


def lowered_text(docs: DataFrame) -> Column:
    """The tampering of the check: A-Z of ``text`` lower-cased where 5 divides the crc32 of the decimal ``doc_id``."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return F.when(chosen, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def leaves_of(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, altered): ``altered`` is the leaf with that text in place of the row's own; null if they are equal."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "lang", "n_chars", "text")
    plain = [F.col(c) for c in FIELDS]
    leaf = leaf_hash(plain)
    other = F.lit(None).cast("binary")
    if altered is not None:
        other = F.when(~altered.eqNullSafe(F.col("text")), leaf_hash([*plain[:-1], altered]))
    return stage(rows.select("doc_id", "source", leaf.alias("leaf"), other.alias("altered")), "merkle-leaves")


def numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` with (block, tree, pos): the number of the source in order, and the place in it."""
    order = ["source", "doc_id", "leaf"]
    ordered = leaves.repartitionByRange(shuffle_width(leaves.sparkSession), *order).sortWithinPartitions(*order)
    names = ["part", "at", "local_tree", "local_pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, tree, pos, last = TaskContext.get().partitionId(), 0, -1, 0, ()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            source = batch.column("source")
            codes = pc.fill_null(source.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            begins = np.ones(n, dtype=bool)
            begins[1:] = codes[1:] != codes[:-1]
            begins[0] = last != (source[0].as_py(),)
            trees = tree + np.cumsum(begins)
            starts = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
            places = np.where(starts >= 0, np.arange(n) - starts, np.arange(n) + pos)
            columns = [np.full(n, part), at + np.arange(n), trees, places]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), *batch.columns], [*names, *batch.schema.names])
            at, tree, pos, last = at + n, int(trees[-1]), int(places[-1]) + 1, (source[n - 1].as_py(),)

    kinds = ", ".join(f"{c} {k}" for c, k in leaves.dtypes)
    rows = stage(ordered.mapInArrow(run, ", ".join(f"{c} long" for c in names) + f", {kinds}"), "merkle-sorted")
    place = F.struct("local_tree", "local_pos", F.sha2("source", 256).alias("name"))
    pieces = rows.groupBy("part").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).orderBy("part").collect()
    based, name, tree, carry = [], None, -1, 0
    for p in pieces:
        goes_on = bool(based) and p["first"]["name"] == name
        tree, carry = (tree, carry) if goes_on else (tree + 1, 0)
        based.append((p["part"], tree, carry))
        single = p["last"]["local_tree"] == 0
        tree, carry, name = tree + p["last"]["local_tree"], (carry + p["n"] if single else p["last"]["local_pos"] + 1), p["last"]["name"]
    bases = leaves.sparkSession.createDataFrame(based, "part long, base_tree long, base_pos long")
    return rows.join(F.broadcast(bases), "part").select(
        (F.col("part") * (1 << 32) + F.floor(F.col("at") / BLOCK)).alias("block"), (F.col("base_tree") + F.col("local_tree")).alias("tree"),
        (F.col("local_pos") + F.when(F.col("local_tree") == 0, F.col("base_pos")).otherwise(0)).alias("pos"), *leaves.columns,
    )


def levels(leaves: DataFrame) -> DataFrame:
    """(tree, level, idx, digest, top) of all nodes over ``leaves`` (tree, idx, digest); ``top`` marks the last of each tree.

    A group of one child at index 0 is a tree that has come to its last node.
    """
    row = leaves.withColumn("level", F.lit(0)).select("tree", "level", "idx", "digest")
    found, level = [], 0
    while True:
        parents = row.groupBy("tree", F.floor(F.col("idx") / FAN).alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        ended = "up = 0 AND size(run) = 1"
        runs = stage(parents, f"merkle-level-{level}")
        found.append(
            runs.select("tree", F.expr(ended).alias("top"), F.explode("run").alias("node")).select(
                "tree", F.lit(level).alias("level"), "node.idx", "node.digest", "top"
            )
        )
        rest = runs.where(f"NOT ({ended})")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, found)
        joined = F.array_join(F.transform("run", lambda x: F.lower(F.hex(x["digest"]))), "")
        level += 1
        row = rest.select("tree", F.lit(level).alias("level"), F.col("up").alias("idx"), F.unhex(F.sha2(joined, 256)).alias("digest"))


def manifest(docs: DataFrame, altered: Column | None = None) -> Manifest:
    """The trees over ``docs`` (doc_id, source, lang, n_chars, text); ``altered`` as in ``leaves_of``."""
    leaves = stage(numbered(leaves_of(docs, altered)), "merkle-numbered")
    below = levels(leaves.select("tree", F.col("pos").alias("idx"), F.col("leaf").alias("digest")))
    subroots = below.where("top").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest")
    nodes = below.unionByName(levels(subroots)).drop("top")
    sizes = stage(leaves.groupBy("tree").agg(F.count("*").alias("n")), "merkle-sizes")
    return Manifest(leaves, nodes, sizes, sizes.count())


def missing(held: np.ndarray, width: int) -> list[tuple[int, int]]:
    """(level, index) of the least set of nodes that, with the nodes ``held`` of level 0, derive all above these."""
    asked, level = [], 0
    while width > 1:
        runs = np.unique(held // FAN)
        needed = (runs[:, None] * FAN + np.arange(FAN)).ravel()
        asked += [(level, int(i)) for i in np.setdiff1d(needed[needed < width], held)]
        held, width, level = runs, -(-width // FAN), level + 1
    return asked


class Climb:
    """The nodes above some leaves of one tree: what was fetched, and what follows from it."""

    def __init__(self, held: dict[int, str], fetched: dict[tuple[int, int], str], width: int) -> None:
        self.runs: list[dict[int, str]] = []
        level = 0
        while width > 1:
            joined, above = {}, {}
            for r in sorted({i // FAN for i in held}):
                children = range(r * FAN, min(width, r * FAN + FAN))
                joined[r] = "".join([held[i] if i in held else fetched[level, i] for i in children])
                above[r] = hashlib.sha256(joined[r].encode()).hexdigest()
            self.runs.append(joined)
            held, width, level = above, -(-width // FAN), level + 1
        self.last = held[0]

    def path(self, index: int) -> Iterator[tuple[str, str]]:
        """What stands before and after the own node in its run, level by level."""
        for joined in self.runs:
            run, at = joined[index // FAN], index % FAN * HEX
            yield run[:at], run[at + HEX :]
            index //= FAN


def proofs(tree: Manifest, challenged: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """One row for each leaf, or each whose doc_id is in ``challenged``: (doc_id, source, leaf, subroot, root,
    proof_sha256, folded_root, verified) and, if ``whole``, ``proof``: the siblings in hex, level by level.

    ``folded_root`` is recomputed from the altered leaf, where there is one, and the original siblings.
    """
    leaves = tree.leaves
    if challenged is not None:
        leaves = leaves.join(challenged.select("doc_id").distinct(), "doc_id", "left_semi").select(leaves.columns)
    held = leaves.groupBy("block", "tree").agg(F.collect_list("pos").alias("held")).join(tree.sizes, "tree").select("block", "tree", "held", "n")
    above = leaves.groupBy("block").agg(F.collect_set("tree").alias("held")).select(
        "block", F.lit(TOP).cast("long").alias("tree"), "held", F.lit(tree.trees).cast("long").alias("n")
    )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block, number, places, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(block, number, level, i) for level, i in missing(np.unique(places), n)]
                rows.append((block, number, -1, n))
            made = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], ["block", "tree", "level", "idx"])

    asked = stage(held.unionByName(above).mapInArrow(ask, "block long, tree long, level long, idx long"), "merkle-asked")
    fetched = asked.where("level >= 0").join(tree.nodes, ["tree", "level", "idx"])
    columns = ["block", "tree", "level", "idx", "digest"]
    told = fetched.select(columns).unionByName(asked.where("level < 0").withColumn("digest", F.lit(None).cast("binary")).select(columns))
    names = ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    kinds = "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def expand(own: pa.Table, told: pa.Table) -> pa.Table:
        nodes: dict[int, dict[tuple[int, int], str]] = {}
        widths: dict[int, int] = {}
        for number, level, i, digest in zip(*(told.column(c).to_pylist() for c in columns[1:]), strict=True):
            if level < 0:
                widths[number] = i
            else:
                nodes.setdefault(number, {})[level, i] = digest.hex()
        rows = list(zip(*(own.column(c).to_pylist() for c in ("tree", "pos", "doc_id", "source", "leaf", "altered")), strict=True))
        members: dict[int, dict[int, str]] = {}
        for number, pos, _, _, leaf, _ in rows:
            members.setdefault(number, {})[pos] = leaf.hex()
        climbs = {number: Climb(x, nodes.get(number, {}), widths[number]) for number, x in members.items()}
        top = Climb({number: x.last for number, x in climbs.items()}, nodes.get(TOP, {}), widths[TOP])
        made, whole_proofs = [], []
        for number, pos, doc_id, source, leaf, altered in rows:
            climb, siblings = climbs[number], []
            now = (altered or leaf).hex()
            for before, after in (*climb.path(pos), *top.path(number)):
                siblings += [before, after]
                now = hashlib.sha256((before + now + after).encode()).hexdigest()
            joined = "".join(siblings)
            made.append((doc_id, source, leaf.hex(), climb.last, top.last, hashlib.sha256(joined.encode()).hexdigest(), now))
            if whole:
                whole_proofs.append([joined[i : i + HEX] for i in range(0, len(joined), HEX)])
        arrays = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.int64(), *[pa.string()] * 6), strict=True)]
        arrays.append(pc.equal(arrays[-1], arrays[names.index("root")]))
        return pa.table([*arrays, *([pa.array(whole_proofs, pa.list_(pa.string()))] if whole else [])], [*names, "verified", *(["proof"] if whole else [])])

    left = leaves.select("block", "tree", "pos", "doc_id", "source", "leaf", "altered").groupBy("block")
    return left.cogroup(told.groupBy("block")).applyInArrow(expand, kinds + (", proof array<string>" if whole else ""))
