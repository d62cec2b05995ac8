"""Languages of words by a linear-chain conditional random field.

A text is a chain of words (runs of letters). A word's features are its character trigrams with its edges,
its affixes of three bytes, and itself if it is in the lexicon of frequent words; transitions between the
languages of neighbouring words are learned. Forward-backward gives each word a probability for each
language, so a text that switches languages is labelled word by word; a document's language is the one
with the most probability over all its words, by their lengths.

The fit is bounded: about ``FIT_DOCS`` documents of each language, drawn by a hash of doc_id from all rows
that may be learnt from, and of each ``FIT_CHAINS`` chains of up to ``CHAIN`` words spread over its length.
A fourth of the chains are spliced from two languages, so that transitions see switches. Features are hashed
to fixed tables. Labelling covers all words of all texts, each text as one chain: a long one is cut into blocks
of ``CHAIN`` words whose products of transition and emission matrices are taken all at once, messages are carried
from block to block in both directions, and blocks are labelled with them. The result is that of the whole chain.

Results by case: a null text, or one without a letter, is ``und`` with score 0; without rows to learn from
all are ``und``; ties go to the language first in order; rows that repeat a doc_id are labelled one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.llm import textscan
from parcelry.llm.common import plain, small, stage, texts

FIT_DOCS, FIT_CHAINS, CHAIN = 500, 6, 64
BITS, LEXICON_BITS = 16, 18
#: Occurrences in the sample that put a word in the lexicon.
FREQUENT = 3
EPOCHS, BATCH, RATE, DECAY = 14, 256, 0.25, 1e-6
FOLDS, HELD_FOLD = 4, 2
UNKNOWN = "und"

#: Bytes of words: ASCII letters and all of multi-byte characters.
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[65:91] = NO_LETTER[97:123] = False
NO_LETTER[128:] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] = np.arange(97, 123)
FOLD[NO_LETTER] = 32


def held_out(key: Column) -> Column:
    """The fold that is never learnt from; a null key is in none."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_FOLD, F.lit(False))


@dataclass
class Features:
    """Hashed features of a piece: one trigram for each byte, three more for each word."""

    trigrams: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    lexical: np.ndarray
    spans: textscan.Spans


def features(piece: textscan.Piece, powers: textscan.Powers) -> Features:
    folded = FOLD[piece.data]
    if len(folded) > 1:  # upper case of the Latin-1 letters, two bytes each
        accented = (piece.data[:-1] == 0xC3) & (piece.data[1:] >= 0x80) & (piece.data[1:] <= 0x9E) & (piece.data[1:] != 0x97)
        folded[1:][accented] += 32
    spans = textscan.words(piece, NO_LETTER)
    padded = np.full(len(folded) + 4, 32, dtype=np.uint64)
    padded[2:-2] = folded
    code = (padded[1:-3] << np.uint64(16)) | (padded[2:-2] << np.uint64(8)) | padded[3:-1]
    with np.errstate(over="ignore"):
        trigrams = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)

        def affix(at: np.ndarray, salt: int) -> np.ndarray:
            codes = (padded[at + 2] << np.uint64(16)) | (padded[at + 3] << np.uint64(8)) | padded[np.minimum(at + 4, len(padded) - 1)]
            return (((codes + np.uint64(salt << 24)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)).astype(np.int32)

        short = np.maximum(spans.ends - 3, spans.starts)
        words = textscan.span_hashes(textscan.Piece(0, folded, piece.offsets), spans, powers)
    return Features(trigrams, affix(spans.starts, 1), affix(short, 2), (words >> np.uint64(64 - LEXICON_BITS)).astype(np.int32), spans)


@dataclass
class Model:
    """Weights by feature and language, and of transitions from row to column."""

    languages: list[str]
    trigram: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    lexical: np.ndarray
    moves: np.ndarray

    def emissions(self, f: Features) -> np.ndarray:
        """A score for each word and language."""
        made = np.empty((len(f.spans.starts), len(self.languages)), dtype=np.float64)
        running = np.zeros(len(f.trigrams) + 1)
        for k in range(len(self.languages)):
            np.cumsum(self.trigram[k][f.trigrams], out=running[1:])
            made[:, k] = running[f.spans.ends] - running[f.spans.starts]
            made[:, k] += self.prefix[k][f.prefix] + self.suffix[k][f.suffix] + self.lexical[k][f.lexical]
        return made


def chains(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each chain: the rows that have words."""
    counts = np.diff(bounds)
    return bounds[:-1][counts > 0], counts[counts > 0]


def _even(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def messages(local: np.ndarray, step: np.ndarray, first: np.ndarray, size: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For blocks of chains, in order: what comes in before each block's first word, and what comes back behind its last.

    A block's matrix takes the label of its first word to that of its last. Carries go block by block for all chains together.
    """
    k = local.shape[1]
    through = np.eye(k)[None] * local[first][:, None, :]
    for t in range(1, int(size.max())):
        on = np.flatnonzero(size > t)
        grown = (through[on] @ step) * local[first[on] + t][:, None, :]
        through[on] = grown / grown.sum(axis=(1, 2), keepdims=True)
    starts = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
    blocks = np.diff(np.append(starts, len(first)))
    order = np.argsort(-blocks, kind="stable")
    starts, blocks = starts[order], blocks[order]
    before, behind = np.ones((len(first), k)), np.ones((len(first), k))
    for nth in range(1, int(blocks[0])):
        at = starts[blocks > nth] + nth
        before[at] = _even(_even((before[at - 1][:, None, :] @ through[at - 1])[:, 0]) @ step)
    for nth in range(int(blocks[0]) - 2, -1, -1):
        at = starts[blocks > nth + 1] + nth
        behind[at] = _even((through[at + 1] @ behind[at + 1][:, :, None])[:, :, 0] @ step.T)
    return before, behind


def marginals(scores: np.ndarray, moves: np.ndarray, bounds: np.ndarray, block: int = CHAIN) -> np.ndarray:
    """Each word's probabilities, every row one chain whatever its length."""
    counts = np.diff(bounds)
    pieces = -(-counts // block)
    row = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    firsts = bounds[:-1][row] + nth * block
    lengths = np.minimum(block, bounds[1:][row] - firsts)
    if not len(firsts) or counts.max() <= block:
        return forward_backward(scores, moves, firsts, lengths)[0]
    ends = messages(np.exp(scores - scores.max(axis=1, keepdims=True)), np.exp(moves), firsts, lengths, row)
    return forward_backward(scores, moves, firsts, lengths, ends=ends)[0]


def forward_backward(scores: np.ndarray, moves: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, pairs: bool = False, ends=None):
    """Each word's probabilities; with ``pairs``, also the expected transitions of all chains. ``ends`` are the messages
    that reach each chain from before its first word and from behind its last.

    All chains step together, the longest first, so that the ones still running are a prefix.
    """
    order = np.argsort(-lengths, kind="stable")
    firsts, lengths = firsts[order], lengths[order]
    marginal = np.empty_like(scores)
    expected = np.zeros_like(moves)
    if not len(firsts):
        return marginal, expected
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(moves)
    running = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths[0]))]
    before, behind = (x[order] for x in ends) if ends else (1.0, np.ones((len(firsts), scores.shape[1])))
    ahead = []
    for t, n in enumerate(running):
        a = before * local[firsts[:n]] if t == 0 else (ahead[-1][:n] @ step) * local[firsts[:n] + t]
        ahead.append(a / a.sum(axis=1, keepdims=True))
    back = behind[: running[-1]]
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        if len(back) < n:
            back = np.concatenate([back, behind[len(back) : n]])
        both = ahead[t] * back
        marginal[firsts[:n] + t] = both / both.sum(axis=1, keepdims=True)
        if t:
            weighed = local[firsts[:n] + t] * back
            if pairs:
                joint = ahead[t - 1][:n, :, None] * step[None] * weighed[:, None, :]
                expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = weighed @ step.T
            back /= back.sum(axis=1, keepdims=True)
    return marginal, expected


def trained_on(sample: list[tuple[str, str]], seed: int = 11) -> Model:
    """Fits a model to (language, chain of words) by stochastic gradients on the chains' likelihood."""
    languages = sorted({lang for lang, _ in sample})
    k = len(languages)
    rng = np.random.default_rng(seed)
    by_name = {name: i for i, name in enumerate(languages)}
    rows = [([w], [by_name[lang]]) for lang, w in sample if w]
    spliced = []
    if k > 1:
        for i in range(len(rows) // 3):
            (a,), (la,) = rows[rng.integers(len(rows))]
            (b,), (lb,) = rows[rng.integers(len(rows))]
            a, b = a.split(" "), b.split(" ")
            spliced.append(([" ".join(a[: 1 + rng.integers(len(a))]), " ".join(b[-1 - rng.integers(len(b)) :])], [la, lb]))
    rows += spliced
    order = rng.permutation(len(rows))
    powers = textscan.Powers()
    model = Model(languages, *(np.zeros((k, 1 << b)) for b in (BITS, BITS, BITS, LEXICON_BITS)), np.zeros((k, k)))
    batches = []
    seen = np.zeros(1 << LEXICON_BITS, dtype=np.int32)
    for at in range(0, len(order), BATCH):
        some = [rows[i] for i in order[at : at + BATCH]]
        texts_, labels = [" ".join(parts) for parts, _ in some], []
        (piece,) = textscan.pieces(pa.array(texts_), 1 << 40)
        f = features(piece, powers)
        for (parts, langs), n in zip(some, np.diff(f.spans.bounds), strict=True):
            own = np.concatenate([np.full(len(p.split(" ")), lang) for p, lang in zip(parts, langs, strict=True)])
            if len(own) != n:
                raise ValueError("a chain must be words of letters between single spaces")
            labels.append(own)
        seen += np.bincount(f.lexical, minlength=len(seen)).astype(np.int32)
        batches.append((f, np.concatenate(labels), *chains(f.spans.bounds)))
    rare = seen < FREQUENT
    tables = (model.trigram, model.prefix, model.suffix, model.lexical)
    squares = [np.full(t.shape, 1e-3) for t in tables]
    moved_squares = np.full((k, k), 1e-3)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(batches)):
            f, labels, firsts, lengths = batches[i]
            marginal, expected = forward_backward(model.emissions(f), model.moves, firsts, lengths, pairs=True)
            error = -marginal
            error[np.arange(len(labels)), labels] += 1
            per_byte = np.repeat(error, f.spans.ends - f.spans.starts, axis=0)
            letters = f.trigrams[~_outside(f)]
            for table, square, index, weight in zip(tables, squares, (letters, f.prefix, f.suffix, f.lexical), (per_byte, error, error, error), strict=True):
                for c in range(k):
                    g = np.bincount(index, weights=weight[:, c], minlength=table.shape[1]) - DECAY * table[c]
                    square[c] += g * g
                    table[c] += RATE * g / np.sqrt(square[c])
            model.lexical[:, rare] = 0
            inner = np.ones(len(labels), dtype=bool)
            inner[firsts] = False
            seen_moves = np.zeros((k, k))
            at = np.flatnonzero(inner)
            np.add.at(seen_moves, (labels[at - 1], labels[at]), 1)
            g = seen_moves - expected
            moved_squares += g * g
            model.moves += RATE * g / np.sqrt(moved_squares)
    for name in ("trigram", "prefix", "suffix", "lexical"):
        setattr(model, name, getattr(model, name).astype(np.float32))
    return model


def _outside(f: Features) -> np.ndarray:
    """The bytes that are in no word."""
    edge = np.zeros(len(f.trigrams) + 1, dtype=np.int64)
    np.add.at(edge, f.spans.starts, 1)
    np.add.at(edge, f.spans.ends, -1)
    return np.cumsum(edge[:-1]) == 0


def letters_of(text: str) -> list[str]:
    """The words of a text as the model sees them."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(raw):
        return []
    spans = textscan.words(textscan.Piece(0, raw, np.array([0, len(raw)])), NO_LETTER)
    data = raw.tobytes()
    return [data[a:b].decode() for a, b in zip(spans.starts, spans.ends, strict=True)]


def chain_sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """(language, chain of words) of a bounded sample of the rows that may be learnt from."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id"))).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = stage(rows.groupBy("lang").agg(F.count("*").alias("n")), "language-sizes")
    uniform = F.xxhash64("doc_id", F.lit(6)).bitwiseAND((1 << 53) - 1) / float(1 << 53)
    drawn = rows.join(small(sizes.toDF("_lang", "n")), F.col("lang") == F.col("_lang")).where(uniform * F.col("n") < FIT_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for value, name in zip(texts(batch), batch.column("lang").to_pylist(), strict=True):
                words = letters_of(value)
                starts = list(range(0, len(words), CHAIN))
                for at in starts[:: max(1, len(starts) // FIT_CHAINS)][:FIT_CHAINS]:
                    made.append((name, " ".join(words[at : at + CHAIN])))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], ["lang", "chain"])

    sample = drawn.select("text", "lang").mapInArrow(run, "lang string, chain string")
    return sorted((r["lang"], r["chain"]) for r in sample.collect())


def trained(docs: DataFrame) -> Model | None:
    sample = chain_sample(docs)
    return trained_on(sample) if sample else None


def has_letter(piece: textscan.Piece, spans: textscan.Spans) -> np.ndarray:
    """Whether each row has a letter of any script."""
    found = np.diff(spans.bounds) > 0
    ascii_letter = ~NO_LETTER[piece.data] & (piece.data < 128)
    running = np.concatenate([[0], np.cumsum(ascii_letter)])
    sure = running[piece.offsets[1:]] > running[piece.offsets[:-1]]
    for row in np.flatnonzero(found & ~sure):
        text = piece.data[piece.offsets[row] : piece.offsets[row + 1]].tobytes().decode()
        found[row] = any(c.isalpha() for c in text)
    return found


def labelled(model: Model, column: pa.Array, powers: textscan.Powers) -> Iterator[tuple[textscan.Piece, Features, np.ndarray, np.ndarray]]:
    """For each piece of a batch: its words' probabilities, and which rows have a letter."""
    for piece in textscan.pieces(column):
        f = features(piece, powers)
        marginal = marginals(model.emissions(f), model.moves, f.spans.bounds)
        yield piece, f, marginal, has_letter(piece, f.spans)


def document_languages(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = textscan.Powers()
        for batch in batches:
            names, scores = [], []
            if model is None:
                names, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            else:
                for piece, f, marginal, letter in labelled(model, batch.column("text"), powers):
                    sizes = (f.spans.ends - f.spans.starts).astype(np.float64)
                    totals = np.zeros((len(sizes) + 1, marginal.shape[1]))
                    np.cumsum(marginal * sizes[:, None], axis=0, out=totals[1:])
                    sums = totals[f.spans.bounds[1:]] - totals[f.spans.bounds[:-1]]
                    share = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300)
                    best = share.argmax(axis=1)
                    names += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)]
                    scores += np.where(letter, np.clip(share[np.arange(piece.rows), best], 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    made = plain(docs, key, text).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def language_spans(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): the runs of words of one language, as begin and end in characters, language and mean probability."""
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = textscan.Powers()
        for batch in batches:
            made = []
            for piece, f, marginal, _ in labelled(model, batch.column("text"), powers):
                character = np.concatenate([[0], np.cumsum((piece.data & 0xC0) != 0x80)])
                best = marginal.argmax(axis=1)
                for row in range(piece.rows):
                    a, b = int(f.spans.bounds[row]), int(f.spans.bounds[row + 1])
                    edges = [a, *(a + 1 + np.flatnonzero(np.diff(best[a:b]))).tolist(), b] if b > a else []
                    zero = character[piece.offsets[row]]
                    made.append([
                        {"begin": int(character[f.spans.starts[i]] - zero), "end": int(character[f.spans.ends[j - 1]] - zero), "lang": model.languages[best[i]], "score": float(marginal[i:j, best[i]].mean())}
                        for i, j in zip(edges, edges[1:], strict=False)
                    ])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, kind)], ["doc_id", "spans"])

    return plain(docs, key, text).mapInArrow(run, "doc_id long, spans array<struct<begin:long,end:long,lang:string,score:double>>")
