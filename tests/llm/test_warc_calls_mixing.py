"""Web archives, tool calls, mixing and the pipeline against plain versions and odd tables."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import random
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from parcelry.llm import byte_bpe, mixing, quality_rules, tool_calls, warc
from parcelry.session import scratch_path

PAGES = "page_id long, url string, html string, record_type string, payload_digest string"
DOCS = "doc_id long, text string, source string, n_tokens int, weight string, h long"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def originals(rows, least):
    firsts = {}
    for page_id, html in rows:
        payload = (html or "").encode()
        if page_id is not None and len(payload) >= least:
            firsts[payload] = min(page_id, firsts.get(payload, page_id))
    return firsts


def page_rows(spark, rows):
    """Extra columns clash with result columns."""
    return spark.createDataFrame([(i, None if i == 3 else f"http://a/{i}\r\nx", t, "mine", "own") for i, t in rows], PAGES)


def test_archives_equal_a_plain_version(spark):
    texts = ["<p>é</p>", "", None, "<p>é</p>", "a\r\n\r\nb", "short", "short", "z" * 300_000, "z" * 300_000, "WARC/1.1\r\n"]
    rows = [(i, texts[i % len(texts)]) for i in range(40)] + [(7, "z" * 300_000), (None, "short"), (None, None)]
    for least in (0, 6):
        firsts = originals(rows, least)
        want = Counter()
        for page_id, html in rows:
            payload = (html or "").encode()
            first = firsts.get(payload)
            again = page_id is not None and first is not None and page_id > first
            want[page_id, len(payload), digest(html), "revisit" if again else "response", first if again else None] += 1
        found = warc.archive_round_trip(page_rows(spark, rows), min_bytes=least)
        columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        assert Counter(map(tuple, found.select(*columns).collect())) == want


def test_archives_return_payloads_and_urls(spark):
    rows = [(1, "one é"), (2, "one é"), (3, None), (4, "x\r\n\r\ny")]
    pages = page_rows(spark, rows)
    folder = scratch_path(spark, "warc-test")
    records = warc.read_records(warc.write_archives(pages, folder), folder)
    got = {r["page_id"]: (r["url"], r["html"]) for r in warc.with_originals(records).collect()}
    assert got == {i: (None if i == 3 else f"http://a/{i}%0D%0Ax", t or "") for i, t in rows}


def test_archives_of_no_pages(spark):
    assert warc.archive_round_trip(page_rows(spark, [])).count() == 0


CALLS = "conv_id long, turn long, call_id string, tool string, arguments string, after string"
RESULTS = "conv_id long, turn long, call_id string, content string"
SCHEMAS = {"add": {"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"enum": ["x", "y"]}}, "required": ["a"], "additionalProperties": False}}


def test_calls_are_linked_ordered_and_checked(spark):
    calls = [
        (1, 0, "r", "add", '{"b": "x", "a": 1}', None), (1, 1, "s", "add", '{"a": true}', "r"), (1, 2, "t", "add", '{"a": -1, "c": "é"}', "s"),
        (1, 3, "x", "add", '{"a": 1}', "y"), (1, 4, "y", "add", '{"a": 1}', "x"), (1, 5, "behind", "add", '{"a": 1}', "y"),
        (2, 0, "self", "add", '{"a": 1}', "self"), (2, 1, "gone", "add", '{"a": 1}', "nowhere"), (2, 2, None, "add", "[1]", "r"),
        (2, 3, "none", "other", '{"a": 1}', None), (2, 4, "bad", "add", None, None), (2, 5, "nan", "add", '{"a": NaN}', None),
        (3, 0, "twin", "add", '{"a": 1}', None), (3, 1, "twin", "add", '{"a": 2}', "r"),
        (5, 0, "inf", "add", '{"a": 1e999}', None), (5, 1, "lone", "add", '{"b": "\\ud800"}', None),
    ]
    results = [(1, 9, "r", "first"), (1, 10, "r", "second"), (1, 9, "s", None), (4, 1, "lost", "q"), (4, 2, None, "q"), (3, 4, "twin", "both")]
    rows = tool_calls.linked(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    got = defaultdict(list)
    for r in rows:
        got[r["call_id"]].append(r)
    assert len(rows) == len(calls) + 2
    facts = lambda i: [(r["depth"], r["status"], r["n_results"], r["valid"]) for r in got[i]]
    assert facts("r") == [(0, "linked", 2, True)]
    assert facts("s") == [(1, "linked", 1, False)] and got["s"][0]["errors"] == "$.a: not of type integer"
    assert facts("t") == [(2, "pending", 0, False)] and got["t"][0]["errors"] == "$.a: below 0; $.c: unknown"
    for name in ("x", "y", "behind", "self"):
        assert facts(name) == [(None, "cyclic", 0, True)]
    assert facts("gone") == [(0, "pending", 0, True)]
    assert got["none"][0]["errors"] == "no schema for other"
    assert {got[i][0]["errors"] for i in ("bad", "nan")} == {"$: not a JSON object"}
    assert {got[i][0]["errors"] for i in ("inf", "lone")} == {"$: holds a number that is not finite or text that is not Unicode"}
    assert facts("lost") == [(None, "orphan", 1, None)]
    assert sorted((r["status"], r["depth"]) for r in got[None]) == [("orphan", None), ("pending", 0)]
    assert [r["status"] for r in got["twin"]] == ["linked", "linked"]
    message = '[{"role":"assistant","tool_calls":[{"function":{"arguments":{"a":1,"b":"x"},"name":"add"},"id":"r","type":"function"}]},{"content":"first","role":"tool","tool_call_id":"r"}]'
    assert got["r"][0]["message"] == message
    assert all(json.dumps(json.loads(r["message"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["message"] for r in rows)


def test_a_long_chain_has_its_depths(spark):
    calls = [(1, i, f"c{i}", "add", '{"a": 1}', f"c{i - 1}" if i else None) for i in range(150)]
    rows = tool_calls.linked(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).collect()
    assert {r["call_id"]: r["depth"] for r in rows} == {f"c{i}": i for i in range(150)}


def test_conversations_that_use_the_same_identifiers(spark):
    calls = [(c, t, f"call_{t}", "add", '{"a": 1}', f"call_{t - 1}" if t else None) for c in (1, 2, None) for t in range(3)]
    results = [(c, 9, f"call_{t}", f"{c}-{t}") for c in (1, 2, None) for t in range(2)]
    messages = [(1, 0, "system", "be kind"), (2, 0, None, None)]
    frames = [spark.createDataFrame(x, k) for x, k in ((calls, CALLS), (results, RESULTS), (messages, "conv_id long, turn long, role string, content string"))]
    rows = tool_calls.linked(*frames[:2], SCHEMAS, frames[2].withColumn("depth", F.lit("extra"))).collect()
    assert len(rows) == 11
    for r in rows:
        if r["status"] != "message":
            assert r["depth"] == r["turn"] and r["n_results"] == (r["turn"] < 2)
            assert r["status"] == ("linked" if r["turn"] < 2 else "pending") and ("content" not in r["message"] or f"{r['conv_id']}-{r['turn']}" in r["message"])
    assert {r["message"] for r in rows if r["status"] == "message"} == {'[{"content":"be kind","role":"system"}]', '[{"content":null,"role":null}]'}


def test_calls_that_need_several_others(spark):
    rng = random.Random(3)
    needs = {i: sorted(rng.sample(range(i), min(i, rng.choice([0, 1, 1, 2, 3])))) for i in range(60)}
    needs |= {70: [71], 71: [70, 3], 72: [70, 5], 73: [5, 99]}
    calls = [(1, i, f"c{i}", "add", '{"a": 1}', [f"c{p}" for p in needs[i]]) for i in needs]
    want = {}
    for i in range(60):
        want[f"c{i}"] = 1 + max((want[f"c{p}"] for p in needs[i]), default=-1)
    want |= {"c70": None, "c71": None, "c72": None, "c73": want["c5"] + 1}
    kind = CALLS.replace("after string", "after array<string>")
    rows = tool_calls.linked(spark.createDataFrame(calls, kind), spark.createDataFrame([], RESULTS), SCHEMAS).collect()
    assert {r["call_id"]: r["depth"] for r in rows} == want


def test_no_calls(spark):
    assert tool_calls.linked(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).count() == 0


def sourced(spark, sizes, words=20):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, f" {'word ' * words}\n", source, 1, "w", 5))
            i += 1
    return spark.createDataFrame(rows, DOCS)


def plan_of(rows):
    return {r["source"]: (r["weight"], r["budget_tokens"]) for r in rows}


def test_mixing_meets_its_budgets(spark):
    docs = sourced(spark, {"big": 3000, None: 300, "small": 60})
    rows = mixing.mixed_copies(docs, entropy_share=0.95, repeats=50.0).collect()
    assert len(rows) == 3360 and {r["n_tokens"] for r in rows} == {20}
    plan = plan_of(rows)
    assert abs(sum(w for w, _ in plan.values()) - 1) < 1e-9
    entropy = -sum(w * math.log(w) for w, _ in plan.values())
    assert abs(entropy - 0.95 * math.log(3)) < 1e-6
    drawn, copies = Counter(), defaultdict(set)
    for r in rows:
        drawn[r["source"]] += r["copies"] * r["n_tokens"]
        copies[r["source"]].add(r["copies"])
    for source, (_, budget) in plan.items():
        assert budget <= drawn[source] < budget + 20
        assert max(copies[source]) - min(copies[source]) <= 1


def test_mixing_keeps_the_limit_on_passes(spark):
    plan = plan_of(mixing.mixed_copies(sourced(spark, {"big": 1000, "small": 10}), entropy_share=1.0, repeats=3.0).collect())
    assert 590 <= plan["small"][1] <= 600


def test_mixing_of_odd_rows(spark):
    odd = [(1, None, "a", 1, "w", 1), (1, None, "a", 1, "w", 1), (None, "x y", "b", 1, "w", 1), (2, "", None, 1, "w", 1), (3, "\t z", "b", 1, "w", 1)]
    rows = mixing.mixed_copies(spark.createDataFrame(odd, DOCS)).collect()
    assert sorted((r["n_tokens"], r["copies"]) for r in rows) == [(0, 1), (0, 1), (0, 1), (1, 1), (2, 1)]
    assert mixing.mix(spark.createDataFrame(odd, DOCS)).columns == [c.split()[0] for c in DOCS.split(", ")]
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_pipeline_equals_its_stages_done_plainly(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in quality_rules.quality_verdicts(docs).where("kept").collect()}
    last = {}
    for i in sorted(good):
        last[exact_dedup_key(held[i]["text"])] = i
    unique = set(last.values())
    classes = brute_classes({i: held[i]["text"] for i in unique}, 5, 80)
    one = set(classes.values())
    kept = spark.createDataFrame([held[i] for i in sorted(one)], docs.schema)
    want = Counter()
    codec = byte_bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in mixing.mixed_copies(kept).collect():
        want[r["doc_id"], len(codec.encode_ordinary(held[r["doc_id"]]["text"] or ""))] += r["copies"]
    got = Counter((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == +want


def exact_dedup_key(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute_classes(texts, width, threshold):
    """The smallest document of each class of linked documents, from all pairs."""
    sets = {}
    for i, text in texts.items():
        words = exact_dedup_key(text).translate({c: 32 for c in range(9, 14)}).split(" ")
        words = [w for w in words if w]
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets)
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in texts}
