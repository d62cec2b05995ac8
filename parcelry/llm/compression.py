"""A quality score from compressed sizes, with zstandard dictionaries made of good and of bad text.

A text is cut into chunks, each compressed once beside a dictionary of good chunks and once beside one of
bad chunks. The difference of the two total sizes, over the text's own size, says which kind of text it
shares more with; a logistic curve fitted to other labelled documents turns it into a probability.

The fit reads a bounded sample of labelled rows: at most ``FIT_ROWS`` of each label for the dictionaries and
as many for the curve, drawn by a hash of doc_id from all rows that may be learnt from, and of the drawn
texts at most ``SAMPLE_BYTES`` of chunks for each dictionary. Scoring covers every chunk of every text.

Results by case: an empty, null or very short text says little, so its score lies near the share of good
documents; of several labels of one document the smallest counts; without labels of both kinds every score
is the share of good ones, a half if there are none.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.llm.common import plain, stage, texts

#: Labelled documents of each label read for the dictionaries, and again for the curve.
FIT_ROWS = 1500
CHUNK_BYTES = 2048
DICTIONARY_BYTES = 1 << 17
#: Bytes of each label from which a dictionary is trained.
SAMPLE_BYTES = 6 << 20
LEVEL = 3
FOLDS, HELD_FOLD = 5, 0
SMOOTHING = 64


def held_out(key: Column) -> Column:
    """The fold that is never learnt from; a null key is in none."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_FOLD, F.lit(False))


def chunks(text: str) -> list[bytes]:
    raw = text.encode()
    return [raw[i : i + CHUNK_BYTES] for i in range(0, len(raw), CHUNK_BYTES)]


@dataclass
class Model:
    """Two dictionaries, and the curve from a difference to a probability."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(content)
            words.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=words, write_content_size=False, write_dict_id=False))
        return made

    def difference(self, by: list[zstandard.ZstdCompressor], text: str) -> float:
        """Between -1 and 1 or so; above 0 if the text lies closer to good than to bad text."""
        parts = chunks(text)
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in by)
        return (bad - good) / (sum(map(len, parts)) + SMOOTHING)

    def probability(self, difference: float) -> float:
        z = self.slope * difference + self.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def dictionary(parts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, k=1024, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(parts)[-DICTIONARY_BYTES:] or bytes(8)


def fitted_curve(differences: np.ndarray, labels: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a weak pull towards zero."""
    if not len(labels):
        return 0.0, 0.0
    x = np.column_stack([differences, np.ones(len(differences))])
    beta, pull = np.zeros(2), np.diag([1e-4, 1e-2])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (labels - p) - pull @ beta)
        beta = beta + np.clip(step, -50, 50)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def drawn_labels(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(_id, label, curve): the first ``rows`` of each label and use by a hash of doc_id, held-out ids left out."""
    marks = labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").cast("int").alias("label"))
    learn = marks.where(~held_out(F.col("_id"))).withColumn("_order", F.xxhash64("_id", F.lit(3))).withColumn("curve", F.pmod(F.xxhash64("_id", F.lit(4)), F.lit(2)) == 1)
    parts = [learn.where((F.col("label") == label) & (F.col("curve") == curve)).orderBy("_order", "_id").limit(rows) for label in (0, 1) for curve in (False, True)]
    return stage(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).select("_id", "label", "curve"), "label-sample")


def sampled_chunks(rows: DataFrame) -> dict[int, list[bytes]]:
    """Chunks of (text, label), of each label the first by a hash and no more than SAMPLE_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(texts(batch), batch.column("label").to_pylist(), strict=True):
                parts = chunks(text)
                if parts:
                    order = [int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little", signed=True) for p in parts]
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(parts), pa.int32()), pa.array(parts), pa.array(order)], ["label", "part", "order"])

    parts = stage(rows.select("text", "label").mapInArrow(run, "label int, part binary, order long"), "label-chunks")
    most = SAMPLE_BYTES // CHUNK_BYTES
    return {label: [bytes(r["part"]) for r in parts.where(F.col("label") == label).orderBy("order", "part").limit(most).collect()] for label in (0, 1)}


def differences(rows: DataFrame, model: Model) -> list[tuple[float, int]]:
    """(difference, label) of every row of (text, label); two numbers a row reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = model.compressors()
        for batch in batches:
            made = pa.array([model.difference(by, t) for t in texts(batch)], pa.float64())
            yield pa.RecordBatch.from_arrays([made, batch.column("label")], ["difference", "label"])

    return [tuple(r) for r in rows.select("text", "label").mapInArrow(run, "difference double, label int").orderBy("difference", "label").collect()]


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits dictionaries and curve. The curve's sample has about as many rows of either label, so its offset is
    then moved to the labels' own shares."""
    docs = plain(docs)
    drawn = drawn_labels(labels)
    sample = stage(docs.join(F.broadcast(drawn), docs["doc_id"] == drawn["_id"]).select("text", "label", "curve"), "label-texts")
    parts = sampled_chunks(sample.where("NOT curve"))
    model = Model(dictionary(parts[1]), dictionary(parts[0]))
    rest = differences(sample.where("curve"), model)
    y = np.array([label for _, label in rest], dtype=float)
    shares = labels.where("quality IN (0, 1)").where(~held_out(F.col("doc_id"))).agg(F.avg("quality").alias("good")).first()["good"]
    share = 0.5 if shares is None else min(max(float(shares), 0.01), 0.99)
    model.offset = math.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        model.slope, offset = fitted_curve(np.array([d for d, _ in rest]), y)
        model.offset += offset - math.log(y.mean() / (1 - y.mean()))
    return model


def quality_scores(docs: DataFrame, model: Model, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = model.compressors()
        for batch in batches:
            scores = [model.probability(model.difference(by, t)) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = plain(docs, key, text).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
