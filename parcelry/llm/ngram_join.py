"""N-gram Jaccard join by partitioning the universe of shingles.

Two sets with ``100 * intersection >= threshold * union`` differ in at most
``H = (100 - t) * (|R| + |S|) / (100 + t)`` shingles. Hashing the universe of shingles into H + 1
segments therefore leaves one segment in which they are equal. More generally, let a probing set give
each segment a slack of -1 (not looked at), 0 (equal) or 1 (differs by one shingle at most, found by
deleting one shingle on either side); if the slacks plus one sum to H + 1, no partner is missed.

- **Size bands.** H depends on the sizes, so sets are banded by size, each band reaching 1 / t^2 times
  its start. A set is indexed at its own band, and at the next one if a partner may lie there.
- **Index.** Every segment's subset is a signature; a twentieth of the segments of a band also carry
  their one-deletion neighbourhoods. Signatures are one row each and meet in one shuffle by key; those
  shared by no two different sets are dropped there.
- **Dull segments.** Empty subsets, and those with nothing but shingles that many sets have, are equal in many sets, which
  says little. A band has more segments than H + 1, and every set leaves out its dullest ones until H + 1 are left, in an order
  that only a subset's content decides. What two sets have equal is in the same order in both, so both leave out
  the same end of it, at most as much as there are spare segments: one equal subset is left, or a trade finds the pair (see
  below), whatever the order. It is taken from a sample of sets (``known_shingles``). Dull segments that carry neighbourhoods
  are set aside: no set looks for equal ones there, but trades still do.
- **Leaders first.** Each shared subset links its members to its smallest one; of its leaders a set is held against
  the one it shares most with, and against others only while the two are not connected. After exact verification
  and connected components, only subsets whose members lie in different components need more work, and only for
  pairs across components. A group of near copies costs its size, not its square.
- **Allocation.** A set whose remaining subsets are crowded trades them, dearest first, for slack 1 on
  the cheapest of its segments that carry neighbourhoods, while that is not crowded too. Costs are counts
  from the index. Nothing is capped: subsets that stay crowded are joined by how their members differ from
  what most of them have (``crowd_links``), which is exact and for texts of a template costs the crowd's size.
- **Verification** first compares parity bitmaps: every set has about a bit for each shingle, the parity of how many
  hash there. Bits that differ between two sets never exceed their difference, so a pair with more than
  H of them is dropped before any set travels, and no true pair is. Then whole sets of 64-bit shingle hashes are
  intersected.

Equal sets are one node throughout, named by a hash of the set, so rows without a ``doc_id`` link others like any
row. Results by case: a null or blank text has an empty set and links with nothing; fewer words than the width are one
shingle; rows that repeat a ``doc_id`` each link by their own text; a null ``doc_id`` can follow a group but is never its
name, and a group of null ids only has none; an empty table gives an empty result; extra columns are not read;
texts of any length are one set. Sets are compared by 64-bit hashes, so two shingles of a pair coincide falsely about
once in 10^19 comparisons.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelry.llm import textscan
from parcelry.llm.common import chosen, plain, settled, small, stage, without
from parcelry.llm.graph import components

#: Members of a shared subset above which its owners may trade it for slack elsewhere.
CROWDED = 8
#: One segment in so many carries one-deletion neighbourhoods.
NEIGHBOURHOOD_EVERY = 20
#: Segments of a band beyond those that its sizes need.
SPARE_PERCENT = 50
#: Sets that frequent shingles are looked for in, how many of these have such a one, and the most that are told apart.
SAMPLED = 8192
FREQUENT = 3
FREQUENT_MOST = 250_000
DELETED = 1 << 24
ASIDE = 1 << 25
BAND = 1 << 26
#: Bits of the smallest parity bitmap.
PARITY_BITS = 1024
#: Square root of the pairs that a difference may bring; members of one that brings more are described by a new centre, not paired.
PAIRED = 64
#: How often a crowd within a crowd is described by a new centre before it is paired.
DESCENTS = 4
#: Members of a group that its centre is taken from, and the share of them (one in so many) that makes a difference a frequent one.
WEIGHED = 256
RARE = 16


class Bands(NamedTuple):
    """Smallest size of each band, its number of segments, how many of those carry neighbourhoods, and how many may be left out."""

    lows: np.ndarray
    segments: np.ndarray
    carrying: np.ndarray
    spare: np.ndarray


def bands(threshold: int, most: int = 1 << 31) -> Bands:
    starts = [1]
    while starts[-1] < most:
        starts.append(max(starts[-1] + 1, starts[-1] * 9 // 8, -(-starts[-1] * 10_000 // threshold**2)))
    lows = np.array(starts, dtype=np.int64)
    highest = lows[1:] - 1
    least = (100 - threshold) * 2 * highest // (100 + threshold) + 1
    spare = np.where(least > 1, -(-least * SPARE_PERCENT // 100), 0)
    segments = least + spare
    carrying = np.where(segments > 1, -(-segments // NEIGHBOURHOOD_EVERY), 0)
    return Bands(lows, segments, carrying, spare)


def levels_of(size: int, threshold: int, known: Bands) -> list[int]:
    """The band of a set, and the next if a partner of this set may be there."""
    own = int(np.searchsorted(known.lows, size, side="right")) - 1
    return [own, own + 1] if size * 100 // threshold >= known.lows[own + 1] else [own]


#: Shingles that many sets have, in ascending order, and how many sets of the sample have each.
Frequent = tuple[np.ndarray, np.ndarray]


def holders_of(shingles: np.ndarray, frequent: Frequent) -> np.ndarray:
    """How many sets of the sample have each shingle; 0 for one that is not frequent."""
    known, holders = frequent
    if not len(known):
        return np.zeros(len(shingles), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    return np.where(known[at] == shingles, holders[at], 0)


def dullness(holders: np.ndarray, segment: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How little each segment's subset tells: fewer the more shingles it has that are not frequent, then by its rarest one; empty ones tell nothing.

    ``holders`` and ``segment`` are in order of segments, which begin at ``edges``. Equal subsets are equally dull.
    """
    dull = np.full(len(edges) - 1, np.iinfo(np.int64).max)
    filled = np.flatnonzero(edges[1:] > edges[:-1])
    dull[filled] = np.minimum.reduceat(holders, edges[filled])
    own = np.bincount(segment[holders == 0], minlength=len(dull))
    return np.where(own > 0, -own, dull)


def signatures(shingles: np.ndarray, threshold: int, known: Bands, frequent: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set, and for each its place: band, whether the segment is set aside, whether one shingle is deleted, segment."""
    keys, places = [], []
    spread, weight = textscan.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), textscan.mix(shingles)
    holders = holders_of(shingles, frequent)
    for level in levels_of(len(shingles), threshold, known):
        m, z = int(known.segments[level]), int(known.carrying[level])
        segment = (spread % np.uint64(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        placed = segment[order]
        running = np.zeros(len(order) + 1, dtype=np.uint64)
        at = np.arange(m, dtype=np.uint64) + np.uint64(level * BAND)
        with np.errstate(over="ignore"):
            np.cumsum(weight[order], dtype=np.uint64, out=running[1:])
            edges = np.searchsorted(placed, np.arange(m + 1))
            sums = running[edges[1:]] - running[edges[:-1]]
            salt = textscan.mix(at * np.uint64(0x9E3779B97F4A7C15))
            key = textscan.mix(sums + salt)
            aside = np.ones(m, dtype=bool)
            aside[np.lexsort((key, dullness(holders[order], placed, edges)))[: m - int(known.spare[level])]] = False
            kept = ~aside | (np.arange(m) < z)
            keys.append(key[kept])
            places.append((at.astype(np.int64) + ASIDE * aside)[kept])
            inner = order[: edges[z]]
            if len(inner):
                own = segment[inner]
                keys.append(textscan.mix(sums[own] - weight[inner] + salt[own]))
                places.append(own + level * BAND + DELETED)
    return np.concatenate(keys), np.concatenate(places)


def parity(shingles: np.ndarray) -> np.ndarray:
    """A bitmap of about a bit for each shingle: of every bit the parity of how many shingles hash there, in 64-bit words."""
    bits = max(PARITY_BITS, 1 << (len(shingles) - 1).bit_length())
    at = textscan.mix(shingles ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(bits)
    odd = (np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def parity_apart(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two bitmaps differ, the longer one folded to the shorter: never more than the sets' difference."""
    words = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, words), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def set_hash(shingles: np.ndarray, seed: int) -> int:
    """An order-free hash of a set."""
    with np.errstate(over="ignore"):
        total = textscan.mix(shingles + np.uint64(seed)).sum(dtype=np.uint64) + np.uint64(len(shingles))
        return int(textscan.mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def shingle_stats(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, e, e2, parity): the size of each row's set, two hashes of it, and its parity bitmap."""
    names = ["doc_id", "n_shingles", "e", "e2", "parity"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        powers = textscan.Powers()
        for batch in batches:
            made = [
                (len(s), set_hash(s, 1), set_hash(s, 2), parity(s).tobytes()) for _, s in textscan.shingle_sets(batch.column("text"), width, powers)
            ]
            if made:
                columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, e long, e2 long, parity binary")


def known_shingles(corpus: Corpus) -> Frequent:
    """The shingles that ``FREQUENT`` or more of about ``SAMPLED`` different sets have. They only decide which subsets are dull: any choice gives the same links."""
    every = max(1, corpus.sets.count() // SAMPLED)
    sample = shingle_arrays(corpus.docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0), corpus.width)
    held = sample.groupBy("e").agg(F.first("shingles").alias("shingles")).select(F.explode("shingles").alias("shingle"))
    held = held.groupBy("shingle").agg(F.count("*").alias("holders")).where(f"holders >= {FREQUENT}")
    found = held.orderBy(F.desc("holders"), "shingle").limit(FREQUENT_MOST).toArrow()
    shingles, holders = found.column("shingle").to_numpy().astype(np.int64).view(np.uint64), found.column("holders").to_numpy().astype(np.int64)
    order = np.argsort(shingles)
    return shingles[order], holders[order]


def signature_rows(corpus: Corpus) -> DataFrame:
    """(key, e, place, n): one row for each signature of each different set of a task."""
    docs, width, threshold = corpus.docs, corpus.width, corpus.threshold
    known = bands(threshold)
    frequent = docs.sparkSession.sparkContext.broadcast(known_shingles(corpus))

    def run(batches):
        powers, seen = textscan.Powers(), set()
        for batch in batches:
            keys, owners, places, sizes, held = [], [], [], [], 0
            for _, shingles in textscan.shingle_sets(batch.column("text"), width, powers):
                if not len(shingles):
                    continue
                e = set_hash(shingles, 1)
                if e in seen:
                    continue
                seen.add(e)
                key, place = signatures(shingles, threshold, known, frequent.value)
                keys.append(key)
                places.append(place)
                owners.append(np.full(len(key), e, dtype=np.int64))
                sizes.append(np.full(len(key), len(shingles), dtype=np.int64))
                held += len(key)
                if held >= 200_000:
                    yield _rows(keys, owners, places, sizes)
                    keys, owners, places, sizes, held = [], [], [], [], 0
            if keys:
                yield _rows(keys, owners, places, sizes)

    return docs.select("text").mapInArrow(run, "key long, e long, place long, n long")


def _rows(keys: list, owners: list, places: list, sizes: list) -> pa.RecordBatch:
    columns = [np.concatenate(keys).view(np.int64), *(np.concatenate(x) for x in (owners, places, sizes))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "e", "place", "n"])


def shingle_arrays(docs: DataFrame, width: int) -> DataFrame:
    """(e, shingles): the whole set of each row with words, as sorted 64-bit hashes, and its hash."""

    def run(batches):
        powers = textscan.Powers()
        for batch in batches:
            held, owners, size = [], [], 0
            for _, shingles in textscan.shingle_sets(batch.column("text"), width, powers):
                if not len(shingles):
                    continue
                held.append(shingles.view(np.int64))
                owners.append(set_hash(shingles, 1))
                size += len(shingles)
                if size >= 500_000:
                    yield _lists(owners, held)
                    held, owners, size = [], [], 0
            if owners:
                yield _lists(owners, held)

    return docs.mapInArrow(run, "e long, shingles array<long>")


def _lists(owners: list, held: list) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held)))
    return pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), lists], ["e", "shingles"])


class Corpus(NamedTuple):
    """The documents (doc_id, text) and, one row for each different set, ``sets``: e, e2, n, parity, rep (its smallest doc_id)."""

    docs: DataFrame
    sets: DataFrame
    width: int
    threshold: int

    def arrays(self, wanted: DataFrame) -> DataFrame:
        """(e, shingles) of the sets in the only column of ``wanted``, staged."""
        wanted = stage(wanted.toDF("e").distinct(), "ngram-wanted")
        wanted = small(wanted)
        reps = stage(self.sets.join(wanted, "e", "left_semi").select("rep"), "ngram-reps")
        rows = chosen(self.docs, reps.where("rep IS NOT NULL"))
        if not reps.where("rep IS NULL").isEmpty():
            rows = rows.unionByName(self.docs.where("doc_id IS NULL"))
        held = shingle_arrays(rows, self.width).join(wanted, "e", "left_semi")
        return stage(held.groupBy("e").agg(F.first("shingles").alias("shingles")), "ngram-sets")


def verified(corpus: Corpus, pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b), those whose sets are similar enough, with both sizes and the intersection's."""
    t = corpus.threshold
    left, right = (corpus.sets.select(F.col("e").alias(c), F.col("parity").alias(f"parity_{c}"), F.col("n").alias(f"size_{c}")) for c in "ab")

    def run(batches):
        for batch in batches:
            a, b, size_a, size_b = (batch.column(c).to_numpy() for c in ("a", "b", "size_a", "size_b"))
            maps = ((np.frombuffer(x.as_py(), dtype=np.uint64) for x in batch.column(f"parity_{c}")) for c in "ab")
            apart = np.fromiter((parity_apart(x, y) for x, y in zip(*maps, strict=True)), dtype=np.int64, count=len(a))
            kept = apart * (100 + t) <= (100 - t) * (size_a + size_b)
            yield pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept])], ["a", "b"])

    near = stage(pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long"), "ngram-pairs")
    sets = corpus.arrays(near.select("a").union(near.select("b")))
    left = sets.select(F.col("e").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("e").alias("b"), F.col("shingles").alias("t"))
    shared = F.size(F.array_intersect("s", "t"))
    return (
        near.join(left, "a")
        .join(right, "b")
        .select("a", "b", F.size("s").alias("n_a"), F.size("t").alias("n_b"), shared.alias("shared"))
        .where(f"shared * 100 >= {t} * (n_a + n_b - shared)")
    )


def ngram_components(docs: DataFrame, width: int = 5, threshold: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the groups of documents linked by similarity.

    ``width`` is in words, ``threshold`` in whole percent. See the module for the method and the cases.
    """
    if not 50 <= threshold <= 100 or width < 1:
        raise ValueError("threshold must be 50 to 100 percent and width at least one word")
    spark, docs = docs.sparkSession, plain(docs, key, text)
    stats = stage(shingle_stats(docs, width), "ngram-stats")
    filled = stats.where("n_shingles > 0")
    sets = stage(
        filled.groupBy("e", "e2", F.col("n_shingles").alias("n")).agg(F.first("parity").alias("parity"), F.min("doc_id").alias("rep")), "ngram-different"
    )
    corpus = Corpus(docs, sets, width, threshold)
    found = settled(spark, lambda: components(ngram_links(corpus), "ngram-components").toDF("e", "component"), "ngram-found")
    linked = found.join(sets.select("e", "rep"), "e")
    names = stage(linked.groupBy("component").agg(F.min("rep").alias("name")), "ngram-names")
    named = sets.join(found.join(small(names), "component").select("e", "name"), "e", "left").select(
        "e", "e2", F.col("n").alias("n_shingles"), F.coalesce("name", "rep").alias("component")
    )
    # Texts without words, which may be many, have no set to look up.
    blank = stats.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return (
        filled.join(named, ["e", "e2", "n_shingles"], "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .unionByName(blank)
    )


def shared_signatures(corpus: Corpus) -> DataFrame:
    """(key, e, place, n) of the signatures that two different sets or more share."""
    by_key = Window.partitionBy("key")
    return (
        signature_rows(corpus)
        .repartition("key")
        .withColumn("_low", F.min("e").over(by_key))
        .withColumn("_high", F.max("e").over(by_key))
        .where("_low < _high")
        .select("key", "e", "place", "n")
        .dropDuplicates()
    )


def leader_links(corpus: Corpus, equal: DataFrame) -> DataFrame:
    """Verified links (a, b) of members of shared subsets to the smallest member, as many as connect them.

    A set may have a leader for each of its segments. It is held against the one it shares most subsets with first,
    and against the others only where that left the two unconnected, so a set travels about once.
    """
    leaders = equal.groupBy("key").agg(F.min(F.struct("e", "n")).alias("a"))
    pairs = equal.join(leaders, "key").where("a.e <> e").groupBy(F.col("a.e").alias("a"), F.col("e").alias("b"), F.col("a.n").alias("n_a"), F.col("n").alias("n_b"))
    by_votes = Window.partitionBy("b").orderBy(F.desc("votes"), "a")
    pairs = stage(pairs.agg(F.count("*").alias("votes")).withColumn("rank", F.row_number().over(by_votes)), "ngram-leaders")
    links = stage(_checked(corpus, pairs.where("rank = 1")), "ngram-first")
    found = components(links, "ngram-components")
    c_a, c_b = found.toDF("a", "c_a"), found.toDF("b", "c_b")
    rest = pairs.where("rank > 1").join(c_a, "a", "left").join(c_b, "b", "left").where("NOT coalesce(c_a = c_b, false)")
    return links.unionByName(_checked(corpus, rest))


def ngram_links(corpus: Corpus) -> DataFrame:
    """Verified links (a, b) between sets that connect all that similarity connects."""
    spark, threshold = corpus.docs.sparkSession, corpus.threshold
    by_key = Window.partitionBy("key")
    index = stage(shared_signatures(corpus), "ngram-index")

    equal = f"place & {DELETED | ASIDE} = 0"
    links = settled(spark, lambda: leader_links(corpus, index.where(equal)), "ngram-links")

    found = settled(spark, lambda: components(links, "ngram-components").toDF("e", "component"), "ngram-found")
    index = index.join(found, "e", "left").withColumn("component", F.coalesce("component", "e"))
    shared_by = (
        index.where(equal)
        .groupBy("key", "component").agg(F.count("*").alias("n_own"))
        .withColumn("n_all", F.sum("n_own").over(by_key))
        .where("n_all > n_own")
    )
    open_rows = stage(
        index.where(equal).join(shared_by, ["key", "component"]).withColumn("cost", F.col("n_all") - F.col("n_own")),
        "ngram-open",
    )
    if open_rows.isEmpty():
        return links
    probes = settled(spark, lambda: allocated(index, open_rows, threshold), "ngram-probes")
    crowd = f"kind = 'equal' AND cost > {CROWDED}"
    a = probes.where(f"NOT ({crowd})").select("key", "kind", F.col("e").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a"))
    b = index.select("key", (F.col("place").bitwiseAND(DELETED) != 0).alias("kind_b"), (F.col("place").bitwiseAND(ASIDE) != 0).alias("aside_b"), F.col("e").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("c_b"))
    fits = "(kind = 'equal' AND NOT kind_b AND NOT aside_b OR kind = 'near' AND kind_b OR kind = 'less' AND NOT kind_b)"
    more = a.join(b, "key").where(f"a <> b AND c_a <> c_b AND {fits}").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n_a", "n_b"
    )
    links = settled(spark, lambda: links.unionByName(_checked(corpus, more)), "ngram-links")
    crowds = open_rows.join(probes.where(crowd).select("key").distinct(), "key", "left_semi").select("key", "e", "n")
    return crowd_links(corpus, stage(crowds, "ngram-crowds"), links)


def crowd_links(corpus: Corpus, crowds: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` with those between members of crowded subsets (key, e, n) added, without pairing the members.

    Crowded subsets that share members form a group, and every member is described by how it differs from the
    group's centre: as the difference of two sets is that of their differences from any third,
    x_R + x_S - 2 * overlap = |R ^ S|. Pairs with x_R + x_S <= H are connected by links to the member nearest to the
    centre. Any other linked pair, R the one farther from the centre, shares a difference among the first H + 1 of R
    and the first H / 2 + 1 of S, in one order of all shingles, and from the first that they share on there are
    enough left of both to bring |R ^ S| down to H. The centre has what most members have and the order puts what
    many differ in last, so members of a template share next to nothing there, whichever they are. Differences
    that bring more than ``PAIRED`` ^ 2 pairs all the same are crowds again: their members are described anew by a
    centre of their own, not paired. So a group costs H rows a member and round. What is left after ``DESCENTS``
    rounds is paired, so no link is lost.
    """
    for descent in range(DESCENTS + 1):
        if crowds.isEmpty():
            break
        links, rows = described(corpus, crowds, links)
        near = F.count_if(F.expr("at <= reach DIV 2")).alias("n_near")
        met = rows.groupBy("root", "shingle").agg(near, F.count("*").alias("n_far"), F.min("component").alias("low"), F.max("component").alias("high"))
        met = stage(met.where("low < high AND n_near > 0").select("root", "shingle", (F.col("n_near") * F.col("n_far")).alias("pairs")), "ngram-met")
        many = F.col("pairs") > PAIRED**2
        paired, again = (met, met.limit(0)) if descent == DESCENTS else (met.where(~many), met.where(many))
        links = stage(links.unionByName(_checked(corpus, sharing(rows.join(paired.drop("pairs"), ["root", "shingle"], "left_semi"), corpus.threshold))), "ngram-links")
        crowds = stage(
            rows.join(again.drop("pairs"), ["root", "shingle"], "left_semi").select(F.xxhash64("root", "shingle").alias("key"), "e", "n"), "ngram-crowds"
        )
    return links


def centres(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(root, centre, late): for each group (e, root) the shingles that most of its members have, and those that many differ in, rarest first.

    Both are taken from up to ``WEIGHED`` members of a group, those with the smallest hashes. They only say from where members are
    described and in which order: any centre and any order give the same links.
    """
    weighed = groups.withColumn("_rank", F.row_number().over(Window.partitionBy("root").orderBy("e"))).where(f"_rank <= {WEIGHED}")
    sizes = weighed.groupBy("root").agg(F.count("*").alias("n"))
    counts = weighed.join(sets, "e").select("root", F.explode("shingles").alias("shingle")).groupBy("root", "shingle").agg(F.count("*").alias("held"))
    differ = F.least("held", F.col("n") - F.col("held"))
    counts = counts.where("held > 1").join(sizes, "root").where(f"held * {RARE} > n").withColumn("differ", differ)
    in_order = F.array_sort(F.collect_list(F.when(F.col("differ") * RARE > F.col("n"), F.struct("differ", "shingle"))))
    made = counts.groupBy("root").agg(F.collect_list(F.when(F.col("held") * 2 > F.col("n"), F.col("shingle"))).alias("centre"), in_order.alias("late"))
    return made.select("root", "centre", F.col("late.shingle").alias("late"))


def described(corpus: Corpus, crowds: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``links`` with those to the member nearest to the centre of each group of ``crowds`` added, and the first H + 1 differences of every member from that centre.

    The differences are (root, e, n, x, reach, component, at, shingle); ``at`` counts from 0, ``reach`` is H for the largest partner.
    """
    threshold = corpus.threshold
    tops = crowds.groupBy("key").agg(F.min("e").alias("a"))
    star = crowds.join(tops, "key").select("a", F.col("e").alias("b")).distinct()
    groups = stage(components(star, "ngram-groups").toDF("e", "root"), "ngram-groups")
    sets = corpus.arrays(groups.select("e"))
    middle = stage(centres(groups, sets), "ngram-centres")
    nothing = F.expr("cast(array() as array<long>)")
    own = groups.join(sets.select("e", F.col("shingles").alias("s")), "e").join(middle, "root", "left")
    own = own.withColumn("t", F.coalesce("centre", nothing)).withColumn("late", F.coalesce("late", nothing))
    apart = F.concat(F.array_except("s", "t"), F.array_except("t", "s"))
    ordered = F.concat(F.array_sort(F.array_except("apart", "late")), F.array_intersect("late", "apart"))
    reach = F.floor((F.col("n") + F.floor(F.col("n") * 100 / threshold)) * (100 - threshold) / (100 + threshold)).cast("int")
    deltas = stage(
        own.select("root", "e", F.size("s").alias("n"), "late", apart.alias("apart"))
        .select("root", "e", "n", F.size("apart").alias("x"), F.slice(ordered, F.lit(1), reach + 1).alias("first"), reach.alias("reach"))
        .withColumn("off", F.expr(f"cast(x as long) * {100 + threshold} - cast(n as long) * {100 - threshold}")),
        "ngram-deltas",
    )
    # Two members are within H of each other by way of the centre if their ``off`` add up to 0 at most, so the smallest reaches all that any other reaches.
    nearest = deltas.groupBy("root").agg(F.min(F.struct("off", "e")).alias("top"))
    close = deltas.join(nearest, "root").where("e <> top.e AND off + top.off <= 0")
    links = stage(links.unionByName(close.select(F.col("top.e").alias("a"), F.col("e").alias("b"))), "ngram-links")
    found = components(links, "ngram-components").toDF("e", "component")
    rows = deltas.join(found, "e", "left").select(
        "root", "e", "n", "x", "reach", F.coalesce("component", "e").alias("component"), F.posexplode("first").alias("at", "shingle")
    )
    return links, stage(rows, "ngram-differences")


def sharing(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b, n_a, n_b): members of different components that share one of the differences in ``rows``, b by its first H / 2 + 1.

    Left out are pairs that could not be similar if that were the first difference they share: it is for one of theirs, so none is lost.
    """
    side = lambda c: [F.col(x).alias(f"{y}_{c}") for x, y in (("n", "n"), ("x", "x"), ("at", "at"), ("component", "c"))]
    far = rows.select("root", "shingle", F.col("e").alias("a"), *side("a"))
    near = rows.where("at <= reach DIV 2").select("root", "shingle", F.col("e").alias("b"), *side("b"))
    apart = f"(x_a + x_b - 2 * least(x_a - at_a, x_b - at_b)) * {100 + threshold} <= {100 - threshold} * (n_a + n_b)"
    pairs = far.join(near, ["root", "shingle"]).where(f"c_a <> c_b AND x_a >= x_b AND {apart}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n_a", "n_b")


def _checked(corpus: Corpus, pairs: DataFrame) -> DataFrame:
    """Verified pairs; sizes too far apart to be similar are left out before any set is read."""
    near = pairs.where(f"a <> b AND 100 * least(n_a, n_b) >= {corpus.threshold} * greatest(n_a, n_b)").select("a", "b").distinct()
    return verified(corpus, near).select("a", "b")


def allocated(index: DataFrame, open_rows: DataFrame, threshold: int) -> DataFrame:
    """(key, e, n, component, kind) to look up: ``equal`` subsets, and for slack 1 a set's subset (``near``)
    against neighbourhoods and its own neighbourhoods (``less``) against subsets.

    The dearest crowded subset of a set is traded for its cheapest slack, the next for the next, while that
    slack is not crowded itself. Segments whose keys nobody shares give slack for nothing.
    """
    band = F.shiftright("place", 26)
    segment = F.col("place").bitwiseAND(DELETED - 1)
    crowded = open_rows.where(F.col("cost") > CROWDED).withColumn("level", band)
    traders = crowded.select("e", "level").distinct()

    _, segments, carrying, _ = bands(threshold)
    zones = F.element_at(F.array(*[F.lit(int(z)) for z in carrying[: int(np.searchsorted(segments, 1 << 24))]]), (F.col("level") + 1).cast("int"))
    zoned = index.withColumn("level", band).withColumn("segment", segment).join(traders, ["e", "level"]).where(F.col("segment") < zones)
    counts = index.groupBy("key").agg(
        F.count_if(F.col("place").bitwiseAND(DELETED) == 0).alias("n_equal"), F.count_if(F.col("place").bitwiseAND(DELETED) != 0).alias("n_less")
    )
    is_equal = F.col("place").bitwiseAND(DELETED) == 0
    slack = (
        zoned.join(counts, "key")
        .groupBy("e", "level", "segment")
        .agg(F.sum(F.when(is_equal, F.col("n_less")).otherwise(F.col("n_equal"))).alias("slack_cost"))
    )
    barred = crowded.select("e", "level", segment.alias("segment"))
    per_set = Window.partitionBy("e", "level")
    offers = (
        slack.join(barred, ["e", "level", "segment"], "left_anti")
        .withColumn("rank", F.row_number().over(per_set.orderBy("slack_cost", "segment")))
    )
    taken = slack.groupBy("e", "level").agg(F.count("*").alias("taken"))
    asks = (
        crowded.select("e", "level", "key", segment.alias("asked"), "cost")
        .withColumn("order", F.row_number().over(per_set.orderBy(F.desc("cost"), "asked")))
        .join(taken, ["e", "level"], "left")
        .withColumn("rank", F.col("order") - (zones - F.coalesce("taken", F.lit(0))))
    )
    trades = stage(
        asks.join(offers, ["e", "level", "rank"], "left").where(f"rank <= 0 OR slack_cost <= {CROWDED}").select("e", "level", "key", "segment"),
        "ngram-trades",
    )
    equal = open_rows.join(trades.select("e", "key"), ["e", "key"], "left_anti").select("key", "e", "n", "component", F.lit("equal").alias("kind"), "cost")
    lifted = zoned.join(trades.where("segment IS NOT NULL").select("e", "level", "segment").distinct(), ["e", "level", "segment"])
    kind = F.when(F.col("place").bitwiseAND(DELETED) == 0, "near").otherwise("less")
    return equal.unionByName(lifted.select("key", "e", "n", "component", kind.alias("kind"), F.lit(0).cast("long").alias("cost")))


def one_of_each(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` less all but the smallest ``doc_id`` of each group; rows without words, or without a doc_id, stay."""
    groups = ngram_components(docs, width, threshold)
    return without(docs, groups.where("component_id < doc_id").select("doc_id"))
