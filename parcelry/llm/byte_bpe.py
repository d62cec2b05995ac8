"""Byte-level BPE by the tiktoken library from a local rank file, and raw-byte decoding.

Texts longer than a segment are cut before the merges, at safe boundaries only: before a single space
between two characters that aren't white space. The pattern begins a match there whatever surrounds it,
so the ids of the parts, end to end, are those of the whole. A stretch without such a place stays whole.

Results by case: a null or empty text has no ids; special tokens' names are ordinary text; rows that
repeat a ``doc_id`` are encoded one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from parcelry.llm.common import plain, texts

SEGMENT_CHARS = 20_000
SAFE = regex.compile(r"(?<=\S)(?= \S)")


def encoding(rank_file: str, split_pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=split_pattern, mergeable_ranks=ranks, special_tokens={})


def segments(text: str, limit: int = SEGMENT_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters, cut at safe boundaries."""
    begin = 0
    while len(text) - begin > limit:
        cut = SAFE.search(text, begin + limit)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:] if begin else text


def encode(codec: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= SEGMENT_CHARS:
        return codec.encode_ordinary(text)
    ids: list[int] = []
    for part in segments(text):
        ids += codec.encode_ordinary(part)
    return ids


def encoded(docs: DataFrame, rank_file: str, split_pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(rank_file, split_pattern)
        for batch in batches:
            for part in _slices(batch):
                ids = [encode(codec, x) for x in texts(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return plain(docs, key, text).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, rank_file: str, split_pattern: str) -> DataFrame:
    """(doc_id, bytes): the bytes of every row's ids, which need not be valid UTF-8 where ids were cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(rank_file, split_pattern)
        for batch in batches:
            made = [codec.decode_bytes(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trips(docs: DataFrame, rank_file: str, split_pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every row encoded and decoded where it is, so that only digests travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(rank_file, split_pattern)
        names = [str(i) for i in range(codec.max_token_value + 1)]
        for batch in batches:
            counts, ids_sha, bytes_sha = [], [], []
            for value in texts(batch):
                ids = encode(codec, value)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                bytes_sha.append(hashlib.sha256(codec.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return plain(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
