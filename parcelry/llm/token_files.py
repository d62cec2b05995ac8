"""Token ids as Arrow IPC files of equal-length sequences and masks.

Documents are laid end to end in ascending ``doc_id`` order, each with an end id, and cut into sequences
of ``length`` ids; the last sequence of a file is padded and its mask says so. A file holds one range of
doc_id: ``part-N.tokens.arrow`` has record batches of the fixed-size lists ``ids`` and ``mask`` (one bit an id), not
compressed, so that any sequence is a view into the mapped file; ``part-N.docs.arrow`` says where each
document begins. Files hold places within themselves; a document's place in the whole comes from the
files' token counts, one row each, so texts are encoded once.

Encoding uses the tokenizers library. Its byte-level split never joins across a space or a line feed
between two characters that aren't white space, so a text without other white space around such places
is looked up part by part among the parts already encoded by this worker, up to a fixed number of
entries; new parts are encoded together. Any other text, and one that holds the string of an added token, is
encoded as it is. Ids are the same either way, and are those of the file as the library reads it: added tokens'
strings become their ids.

Results by case: a null or empty text is its end id alone; texts of any length are encoded whole; rows with equal doc_id follow each other in
the order of their texts; null doc_ids come first; an empty table writes no documents; extra columns are not read.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parcelry.llm.common import plain, shuffle_width, stage
from parcelry.llm.shared_files import committed, file_system
from parcelry.session import scratch_path

LENGTH = 2048
SEQUENCES_PER_BATCH = 256
#: Parts a worker remembers; about 200 bytes each.
REMEMBERED = 800_000
MOST_TASKS = 20_000
#: Text of a file, at most on average.
FILE_BYTES = 256 << 20


class Codec:
    """A tokenizer file, with what a worker remembers of it."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.begins = np.zeros(size, dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.begins[i] = token.startswith("Ġ")
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.line_feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        split = [None if any(x in t for x in self.added) else self._lines(t) for t in texts]
        get = self.known.get
        found = [None if lines is None else [list(map(get, parts)) for parts in lines] for lines in split]
        new: set[str] = set()
        for lines, ids in zip(split, found, strict=True):
            for parts, some in zip(lines or (), ids or (), strict=True):
                if None in some[1:]:
                    new.update(p for p, x in zip(parts[1:], some[1:], strict=True) if x is None)
        fresh = self._new(list(new))
        if len(self.known) + len(fresh) <= REMEMBERED:
            self.known.update(fresh)
        made = []
        for text, lines, ids in zip(texts, split, found, strict=True):
            if lines is None:
                made.append(self.whole(text) if text else b"")
                continue
            out = []
            for parts, some in zip(lines, ids, strict=True):
                some[0] = self._first(parts[0])
                out.append(self.line_feed)
                out.extend(fresh[p] if x is None else x for p, x in zip(parts, some, strict=True)) if None in some else out.extend(some)
            made.append(b"".join(out[1:]))
        return made

    @staticmethod
    def _lines(text: str) -> list[list[str]] | None:
        """The parts of each line of ``text``; none where it begins, ends or goes on with white space after white space."""
        words = text.split()
        if not words or sum(map(len, words)) + len(words) - 1 != len(text):
            return None
        return [line.split(" ") for line in text.split("\n")] if "\n" in text or text.count(" ") != len(words) - 1 else [words]

    def _first(self, part: str) -> bytes:
        """A part that follows no space."""
        key = "\n" + part
        found = self.known.get(key)
        if found is None:
            found = self.whole(part)
            if len(self.known) < REMEMBERED:
                self.known[key] = found
        return found

    def _new(self, parts: list[str]) -> dict[str, bytes]:
        """Parts that follow a space, encoded together: each begins with the one id of it that begins with a space."""
        made: dict[str, bytes] = {}
        for at in range(0, len(parts), 20_000):
            some = parts[at : at + 20_000]
            text = " " + " ".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cuts = np.flatnonzero(self.begins[ids])
            if len(cuts) != len(some):
                made.update((p, self.whole(" " + p)) for p in some)
                continue
            raw, size = ids.tobytes(), self.dtype.itemsize
            edges = [*(cuts * size).tolist(), len(raw)]
            made.update((p, raw[a:b]) for p, a, b in zip(some, edges, edges[1:], strict=False))
        return made


def worker_codec(path: str) -> Codec:
    """The codec of this worker process, kept from task to task."""
    held = sys.modules.setdefault("_parcelry_codecs", types.ModuleType("_parcelry_codecs")).__dict__
    if path not in held:
        held[path] = Codec(path)
    return held[path]


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them as record batches."""

    def __init__(self, out, dtype: np.dtype, length: int) -> None:
        self.dtype, self.length, self.held, self.size = dtype, length, [], 0
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(out, self.schema)

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= SEQUENCES_PER_BATCH * self.length * self.dtype.itemsize:
            self._write(whole_only=True)

    def close(self) -> None:
        self._write(whole_only=False)
        self.file.close()

    def _write(self, whole_only: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), dtype=self.dtype)
        per_batch = SEQUENCES_PER_BATCH * self.length
        upto = len(ids) // per_batch * per_batch if whole_only else len(ids)
        for at in range(0, upto, per_batch):
            some = ids[at : min(upto, at + per_batch)]
            rows = -(-len(some) // self.length)
            padded = np.zeros(rows * self.length, dtype=self.dtype)
            padded[: len(some)] = some
            mask = np.arange(rows * self.length) < len(some)
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)]
            self.file.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        rest = ids[upto:].tobytes()
        self.held, self.size = ([rest] if rest else []), len(rest)


class Sequences:
    """Random access to the sequences of one file; over a memory map nothing is copied."""

    def __init__(self, source) -> None:
        self.reader = pa.ipc.open_file(source)
        self.per_batch = SEQUENCES_PER_BATCH

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return (n - 1) * self.per_batch + self.reader.get_batch(n - 1).num_rows if n else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of a sequence, both views into the file."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        batch = self.reader.get_batch(i // self.per_batch)
        ids, mask = (batch.column(c)[i % self.per_batch].values for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask

    def streams(self) -> Iterator[np.ndarray]:
        """The ids without padding, batch by batch."""
        for k in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(k)
            ids, mask = (batch.column(c).flatten() for c in ("ids", "mask"))
            yield ids.to_numpy()[: mask.true_count]


DOCS = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])


def write_tokens(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 0, length: int = LENGTH, key: str = "doc_id", text: str = "text", files: int | None = None) -> DataFrame:
    """Encodes and writes all rows; returns (part, n_docs, n_tokens) for each file."""
    rows = plain(docs, key, text)
    if files is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(shuffle_width(docs.sparkSession), -(-size // FILE_BYTES))
    ordered = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, codec = TaskContext.get().partitionId(), worker_codec(tokenizer_file)
        end = np.array([end_id], dtype=codec.dtype).tobytes()
        n_docs = offset = 0
        with committed(folder, f"part-{part:06d}.tokens.arrow") as tokens, committed(folder, f"part-{part:06d}.docs.arrow") as index:
            sequences, places = SequenceWriter(tokens, codec.dtype, length), pa.ipc.new_file(index, DOCS)
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    some = batch.slice(at, 1000)
                    counts = []
                    for ids in codec.encode([x or "" for x in some.column("text").to_pylist()]):
                        sequences.add(ids + end)
                        counts.append(len(ids) // codec.dtype.itemsize + 1)
                    offsets = offset + np.concatenate([[0], np.cumsum(counts)])
                    places.write_batch(pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(offsets[:-1]), pa.array(counts, pa.int64())], schema=DOCS))
                    offset, n_docs = int(offsets[-1]), n_docs + len(counts)
            sequences.close()
            places.close()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, n_docs, offset)], ["part", "n_docs", "n_tokens"])

    return stage(ordered.mapInArrow(run, "part long, n_docs long, n_tokens long"), "token-parts")


def read_documents(parts: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone; ``parts`` only says which there are."""
    based = parts.withColumn("base", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).select("part", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for part, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{root}/part-{part:06d}.tokens.arrow") as tokens, fs.open_input_file(f"{root}/part-{part:06d}.docs.arrow") as index:
                    stream, held = Sequences(tokens).streams(), np.zeros(0, dtype=np.uint32)
                    places = pa.ipc.open_file(index)
                    for k in range(places.num_record_batches):
                        rows = places.get_batch(k)
                        sums = []
                        for n in rows.column("n_tokens").to_pylist():
                            value = 0
                            while n > len(held):
                                value, n = zlib.crc32(held.tobytes(), value), n - len(held)
                                held = next(stream).astype("<u4")
                            sums.append(zlib.crc32(held[:n].tobytes(), value))
                            held = held[n:]
                        starts = pa.array(rows.column("offset").to_numpy() + base)
                        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), starts, rows.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, min(parts.count(), MOST_TASKS))
    return based.repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer_file: str, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """Writes the files and reads every document back from them."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_documents(write_tokens(docs, folder, tokenizer_file, end_id, length), folder)
