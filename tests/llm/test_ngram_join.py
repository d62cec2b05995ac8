"""The n-gram Jaccard join against all pairs of small tables."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from parcelry.llm import graph, ngram_join
from parcelry.llm.ngram_join import bands, levels_of, ngram_components, one_of_each

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, width: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows: list[tuple], width: int, threshold: int) -> dict:
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= threshold * (len(sets[a]) + len(sets[b]) - shared):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(words: list[str], edits: int, rng: random.Random) -> str:
    words = list(words)
    for _ in range(edits):
        kind = rng.random()
        at = rng.randrange(len(words))
        if kind < 0.6:
            words[at] = f"new{rng.randrange(30)}"
        elif kind < 0.8:
            del words[at]
        else:
            words.insert(at, f"ins{rng.randrange(30)}")
    return " ".join(words)


def variants(seed: int) -> list[tuple]:
    """Groups of near copies of many sizes of text, most pairs close to the thresholds, and strangers that share passages."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    texts: list[str | None] = [None, "", " \t\n", "One", "one", "a b", "A B", "a b c"]
    for size, copies, most in ((40, 12, 3), (120, 60, 9), (150, 40, 4), (400, 20, 20), (9, 8, 1)):
        base = [f"w{rng.randrange(400)}" for _ in range(size)]
        texts += [edited(base, rng.randrange(most + 1), rng) for _ in range(copies)]
    for _ in range(40):
        own = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 90))]
        at = rng.randrange(len(own))
        texts.append(" ".join(own[:at] + passage + own[at:]))
    texts += texts[10:40]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("width", "threshold", "crowded"), [(3, 90, 8), (5, 80, 0)])
def test_equals_all_pairs(spark, monkeypatch, width, threshold, crowded):
    monkeypatch.setattr(ngram_join, "CROWDED", crowded)
    monkeypatch.setattr(ngram_join, "PAIRED", crowded)
    rows = variants(threshold + crowded)
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width, threshold).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, width, threshold)


@pytest.mark.parametrize("threshold", [75, 80, 90, 100])
def test_a_partner_is_in_the_own_band_or_the_next(threshold):
    known = bands(threshold)
    for size in [*range(1, 60), *range(60, 700, 23)]:
        most = size * 100 // threshold
        for other in {size, (size + most) // 2, most}:
            shared = set(levels_of(size, threshold, known)) & set(levels_of(other, threshold, known))
            own = max(levels_of(other, threshold, known)[0], levels_of(size, threshold, known)[0])
            assert own in shared
            assert known.segments[own] > (100 - threshold) * (size + other) // (100 + threshold)
    assert (known.carrying <= known.segments).all()


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(None, "x y z q", "k", 1), (1, "x y z q", "k", 2), (1, "x y z q", "k", 3), (2, None, None, 4), (2, "lone words here", None, 5), (None, "", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, n_shingles int")
    got = sorted(ngram_components(docs, 3, 90).collect(), key=str)
    assert [tuple(r) for r in got if r["n_shingles"] == 2] == [(1, 2, 1), (1, 2, 1), (None, 2, 1)]
    assert {tuple(r) for r in got if r["n_shingles"] < 2} == {(2, 0, 2), (2, 1, 2), (None, 0, None)}
    kept = one_of_each(docs, 3, 90)
    assert kept.columns == docs.columns
    assert kept.count() == 6


def test_rows_without_an_id_link_others(spark):
    words = [f"w{i}" for i in range(60)]
    middle = [*words[:20], "x", *words[21:]]
    last = [*words[:20], "x", *words[21:40], "y", *words[41:]]
    texts = [(1, " ".join(words)), (None, " ".join(middle)), (3, " ".join(last)), (None, "else where now"), (None, "else where now")]
    got = ngram_components(spark.createDataFrame(texts, "doc_id long, text string"), 3, 90).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == [(1, 1), (3, 1), (None, 1), (None, None), (None, None)]


def test_regular_words_of_any_length_are_told_apart(spark):
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    mirror = word.translate(str.maketrans("ab", "ba"))
    got = ngram_components(spark.createDataFrame([(1, word), (2, mirror), (3, word.upper())], "doc_id long, text string"), 3, 90).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 1}


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(4)
    for size in (1, 30, 3000, 5000):
        for other in (size, size * 2):
            a, b = (np.unique(rng.integers(0, 2 * size + 2, n).astype(np.uint64)) for n in (size, other))
            assert ngram_join.parity_apart(ngram_join.parity(a), ngram_join.parity(b)) <= len(np.setxor1d(a, b))


def test_empty_table(spark):
    assert ngram_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_very_long_text_and_its_copy(spark):
    words = [f"w{i % 7919}x{i}" for i in range(60_000)]
    changed = list(words)
    changed[100] = changed[40_000] = "other"
    docs = spark.createDataFrame([(5, " ".join(words)), (3, " ".join(changed)), (9, "w0x0")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_components(docs, 3, 90).collect()}
    assert got == {5: 3, 3: 3, 9: 9}
    assert sorted(r["doc_id"] for r in one_of_each(docs, 3, 90).collect()) == [3, 9]


def looked_at(spark, monkeypatch, n, slots):
    """Candidates, groups and linked members of ``n`` texts of one template and a root that shares nothing with them."""
    base = [f"w{i}" for i in range(60)]

    def member(i):
        words = list(base)
        for slot in range(slots):
            words[3 + slot * 4] = f"own{i}x{slot}"
        return " ".join(words)

    strangers = [" ".join(f"s{k}x{i}" for i in range(60)) for k in range(4 * n)]
    docs = spark.createDataFrame(list(enumerate([member(i) for i in range(n)] + strangers)), "doc_id long, text string")
    stats = ngram_join.shingle_stats(docs, 5).collect()
    least = min(r["e"] for r in stats if r["doc_id"] < n)
    strange = next(r["doc_id"] for r in stats if r["doc_id"] >= n and r["e"] < least)
    docs = docs.where(f"doc_id < {n} OR doc_id = {strange}")
    sets = ngram_join.shingle_stats(docs, 5).selectExpr("e", "e2", "n_shingles AS n", "parity", "doc_id AS rep")
    looked, plain_check = [], ngram_join._checked

    def counting(corpus, pairs):
        looked.append(pairs.count())
        return plain_check(corpus, pairs)

    with monkeypatch.context() as patched:
        patched.setattr(ngram_join, "PAIRED", 8)
        patched.setattr(ngram_join, "_checked", counting)
        corpus = ngram_join.Corpus(docs, sets, 5, 80)
        links = ngram_join.crowd_links(corpus, sets.selectExpr("1L AS key", "e", "n"), spark.createDataFrame([], "a long, b long"))
        groups = {r["component"] for r in ngram_join.components(links).collect()}
    return sum(looked), len(groups), links.selectExpr("explode(array(a, b)) AS e").distinct().count()


def test_near_copies_with_a_foreign_root_are_all_linked(spark, monkeypatch):
    looked, groups, members = looked_at(spark, monkeypatch, 250, 1)
    assert (groups, members) == (1, 250)
    assert looked <= 4 * 250


def test_candidates_of_a_template_grow_with_its_size(spark, monkeypatch):
    few, *none = looked_at(spark, monkeypatch, 200, 4)
    many, *still = looked_at(spark, monkeypatch, 800, 4)
    assert none == still == [0, 0]
    print("candidates", few, many)
    assert many <= 6 * few


def test_a_template_whose_texts_are_changed_in_places_of_their_own(spark, monkeypatch):
    # Whichever text is the root, all others have in common what it lacks of the template.
    rnd, n = random.Random(5), 200
    base = [f"w{i}" for i in range(200)]

    def member(i):
        words = list(base)
        for slot, at in enumerate(rnd.sample(range(200), 9)):
            words[at] = f"own{i}x{slot}"
        return " ".join(words)

    rows = [(i, member(i)) for i in range(n)]
    rows += [(n + i, t.replace("own", "other", 1)) for i, t in rows[:20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = ngram_join.shingle_stats(docs, 5).selectExpr("e", "e2", "n_shingles AS n", "parity", "doc_id AS rep")
    looked, plain_check = [], ngram_join._checked

    def counting(corpus, pairs):
        looked.append(pairs.count())
        return plain_check(corpus, pairs)

    monkeypatch.setattr(ngram_join, "_checked", counting)
    corpus = ngram_join.Corpus(docs, sets, 5, 80)
    links = ngram_join.crowd_links(corpus, sets.selectExpr("1L AS key", "e", "n"), spark.createDataFrame([], "a long, b long"))
    names = dict(sets.select("e", "rep").collect())
    groups = {}
    for e, c in ngram_join.components(links).collect():
        groups.setdefault(c, set()).add(names[e])
    found = {i: min(g) for g in groups.values() for i in g}
    wanted = {i: c for i, (_, c) in brute(rows, 5, 80).items()}
    assert {i: found.get(i, i) for i, _ in rows} == wanted
    assert sum(c != i for i, c in wanted.items()) >= 20
    assert sum(looked) <= 5 * n


def test_passages_that_many_texts_have_make_no_crowds(spark, monkeypatch):
    # A third of each text is one of two passages; the rest is its own. Only the last ten texts are near copies.
    rnd = random.Random(9)
    passages = [[f"p{k}x{i}" for i in range(60)] for k in range(2)]
    rows = [[*passages[i % 2], *(f"own{i}x{k}" for k in range(rnd.randrange(100, 180)))] for i in range(300)]
    rows += [[*words[:-1], "else"] for words in rows[-10:]]
    rows = [(i, " ".join(words)) for i, words in enumerate(rows)]
    crowded, plain_crowds = [], ngram_join.crowd_links

    def counting(corpus, crowds, links):
        crowded.append(crowds.count())
        return plain_crowds(corpus, crowds, links)

    monkeypatch.setattr(ngram_join, "crowd_links", counting)
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 5, 80)
    assert sum(crowded) == 0


def test_any_order_of_dullness_gives_the_same_links(spark, monkeypatch):
    rows = variants(7)
    monkeypatch.setattr(ngram_join, "CROWDED", 2)
    monkeypatch.setattr(ngram_join, "dullness", lambda holders, segment, edges: np.zeros(len(edges) - 1, dtype=np.int64))
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 5, 80)


@pytest.mark.parametrize("few", [0, graph.FEW_LINKS])
def test_components_in_rounds_and_in_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_LINKS", few)
    links = [(i, i + 1) for i in range(40)] + [(100, 70), (70, 90), (5, 5), (None, 3), (200, 300), (200, 300)]
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(41)] + [(70, 70), (90, 70), (100, 70), (200, 200), (300, 200)]
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
