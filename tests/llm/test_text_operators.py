"""Scans, quality rules, compression scores, languages and encodings against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from parcelry.llm import byte_bpe, compression, quality_rules, token_files, word_language

ODD = [None, "", " \t\n", "one", "a b", "Ünï cödé ß x", "a  b\n\n c \r\n", "!!! ??? ###", "12 34", "\n".join(["same line here"] * 9), "word " * 3000]
#: One word of most shapes, repeated lines, and a text far longer than a piece.
LONG = "\n".join(f"line {i % 500} of {'x' * (i % 17)} the long text" for i in range(30_000))


def documents(spark, texts):
    """Extra columns clash with every result column."""
    rows = [(i, t, "x", 1, "src", "en") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int, source string, lang string")


def counts_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {t for t, n in Counter(triples).items() if n > 1}
    covered = {i + k for i, t in enumerate(triples) if t in often for k in range(3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_a_plain_version(spark):
    texts = [*ODD, LONG, "a b c a b c d a b c", "x | y | z *** $$ <b>"]
    got = {r["doc_id"]: r for r in quality_rules.quality_verdicts(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        row = got[i]
        want = counts_of(text)
        assert tuple(row[c] for c in quality_rules.COUNTS[:5]) == want
        assert row["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (row["kept"] and row["base_failed"])


def test_fit_finds_planted_accuracies():
    rng = np.random.default_rng(3)
    n = 200_000
    good = rng.random(n) < 0.8
    cast = np.ones((n, 4), dtype=int)
    for k, (alarm, hit) in enumerate([(0.002, 0.4), (0.004, 0.3), (0.001, 0.5), (0.003, 0.6)]):
        bad = np.where(good, rng.random(n) < alarm, rng.random(n) < hit)
        cast[:, k] = np.where(rng.random(n) < 0.1, quality_rules.ABSTAIN, np.where(bad, quality_rules.BAD, quality_rules.GOOD))
    codes = (cast * 3 ** np.arange(4)).sum(axis=1)
    weights = quality_rules.fitted(Counter(codes.tolist()), 4)
    assert abs(weights.good - 0.8) < 0.05
    assert np.abs(weights.says_bad[0] - [0.4, 0.3, 0.5, 0.6]).max() < 0.1
    assert quality_rules.fitted({}, 4).good == 0.7


def test_kept_rows_keep_their_columns(spark):
    prose = " ".join(f"word{i}" for i in range(120))
    docs = documents(spark, [prose, " ".join(f"word{i}*** $$" for i in range(120)), None, prose])
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in quality_rules.quality_verdicts(docs).where("kept").collect())
    assert quality_rules.keep_good(docs.limit(0)).collect() == []
    assert quality_rules.quality_verdicts(docs.limit(0)).collect() == []


@pytest.fixture(scope="module")
def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_compression_separates_held_out_labels(spark, sf, tables):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = compression.quality_scores(docs, compression.trained(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([s >= 0.3 for s in good]) > 0.9
    assert all(0 <= s <= 1 for s in good + bad)


def test_compression_of_odd_tables(spark, tables):
    docs = documents(spark, [*ODD, LONG])
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = compression.quality_scores(docs, compression.trained(docs, none)).collect()
    assert {r["score"] for r in rows} == {0.5} and len(rows) == len(ODD) + 1
    mixed = spark.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1), (9, 1), (8, 0), (77, 1)], "doc_id long, quality int")
    rows = compression.quality_scores(docs, compression.trained(docs, mixed)).collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_forward_backward_sums_over_all_paths():
    rng = np.random.default_rng(5)
    scores, moves = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    firsts, lengths = np.array([0, 4]), np.array([4, 1])
    marginal, expected = word_language.forward_backward(scores, moves, firsts, lengths, pairs=True)
    want, pairs, total = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for path in np.ndindex(3, 3, 3, 3):
        weight = np.exp(sum(scores[i, p] for i, p in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += weight
        for i, p in enumerate(path):
            want[i, p] += weight
        for a, b in zip(path, path[1:], strict=False):
            pairs[a, b] += weight
    assert np.allclose(marginal[:4], want / total)
    assert np.allclose(expected, pairs / total)
    assert np.allclose(marginal[4], np.exp(scores[4]) / np.exp(scores[4]).sum())


def test_languages_of_code_switched_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = word_language.trained(docs)
    rows = word_language.document_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95
    english, french = (docs.where(f"lang = '{x}' AND n_chars > 900").orderBy("doc_id").first()["text"][:300] for x in ("en", "fr"))
    switched = documents(spark, [f"{english}\n{french}", *ODD])
    spans = {r["doc_id"]: r["spans"] for r in word_language.language_spans(switched, model).collect()}
    by_lang = Counter()
    for s in spans[0]:
        by_lang[s["lang"], s["begin"] > len(english)] += s["end"] - s["begin"]
    assert by_lang["en", False] > 0.7 * len(english) * 0.8 and by_lang["fr", True] > 0.7 * len(french) * 0.8
    found = {r["doc_id"]: r for r in word_language.document_languages(switched, model).collect()}
    for i, text in enumerate(ODD, 1):
        assert (found[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= found[i]["score"] <= 1


def test_no_rows_to_learn_from(spark):
    docs = documents(spark, ODD).limit(0)
    assert word_language.trained(docs) is None
    assert {r["lang_pred"] for r in word_language.document_languages(documents(spark, ODD), None).collect()} == {"und"}


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TRICKY = [*ODD, LONG, "  two  spaces ", "tab\tand\nfeed", "it's we'll  don't", "<|endoftext|> a", "x" * 30_000, "é ü ß " * 9000, "a b  c\x1cd e", " lead", "trail ", "a\n b\n\nc"]


def test_byte_bpe_equals_the_library(spark):
    codec = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    got = {r["doc_id"]: r for r in byte_bpe.round_trips(documents(spark, TRICKY), RANKS, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(TRICKY):
        ids = codec.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    rows = byte_bpe.encoded(documents(spark, TRICKY[:12]), RANKS, public_tokenizers.PATTERN)
    back = {r["doc_id"]: bytes(r["bytes"]) for r in byte_bpe.decoded(rows, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(TRICKY[:12])}


def test_segments_join_to_the_whole():
    rng = random.Random(2)
    codec = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", " ", "  ", "\n", "'s", "9", "!", "é", " ", "\t"]) for _ in range(rng.randrange(80)))
        parts = list(byte_bpe.segments(text, 5))
        assert "".join(parts) == text
        assert [i for p in parts for i in codec.encode_ordinary(p)] == codec.encode_ordinary(text)


def test_token_files_equal_the_library(spark, tmp_path, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    order = random.Random(4).sample(range(len(TRICKY)), len(TRICKY))
    docs = documents(spark, TRICKY)
    folder = str(tmp_path / "tokens")
    parts = token_files.write_tokens(docs.orderBy(docs["doc_id"].isin(order[:5])), folder, path, end_id=0, length=64, files=4)
    got = {r["doc_id"]: r for r in token_files.read_documents(parts, folder).collect()}
    whole = Tokenizer.from_file(path)  # as the library reads it: added tokens' strings are their ids
    start, stream = 0, []
    for i, text in enumerate(TRICKY):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        stream += ids.tolist()
    found = []
    for name in sorted((tmp_path / "tokens").glob("*.tokens.arrow")):
        sequences = token_files.Sequences(pa.memory_map(str(name)))
        for k in range(len(sequences)):
            ids, mask = sequences[k]
            assert len(ids) == len(mask) == 64 and not ids.flags.owndata
            found += ids[mask.to_numpy(zero_copy_only=False)].tolist()
    assert found == stream


def test_a_long_text_is_one_chain():
    rng = np.random.default_rng(8)
    bounds = np.array([0, 70, 70, 71, 300, 364, 500])
    scores, moves = rng.normal(0, 2, (500, 3)), rng.normal(0, 2, (3, 3))
    whole, _ = word_language.forward_backward(scores, moves, *word_language.chains(bounds))
    for block in (1, 5, 64, 1000):
        assert np.allclose(word_language.marginals(scores, moves, bounds, block), whole)


def test_token_files_of_an_empty_table(spark):
    assert token_files.token_round_trip(documents(spark, []), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_parts_of_lines_are_those_between_single_white_space():
    rnd = random.Random(2)
    pieces = ["a", "bc", "ß", "9", ".", " ", "\n", "\t", "\x1c", "\x85", " ", "​", "<|endoftext|>"]
    odd = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 9))) for _ in range(5000)]
    for text in odd:
        unsafe = re.search(r"\s\s|\A\s|\s\Z|\A\Z", text)
        assert token_files.Codec._lines(text) == (None if unsafe else [line.split(" ") for line in text.split("\n")])
    path = public_tokenizers.path("byte_bpe_50k.json")
    codec, library = token_files.Codec(path), Tokenizer.from_file(path)
    got = [*codec.encode(odd[:2500]), *codec.encode(odd[2500:]), *codec.encode(odd[:50])]
    for text, ids in zip(odd + odd[:50], got, strict=True):
        assert np.frombuffer(ids, dtype=codec.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
