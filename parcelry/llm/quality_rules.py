"""Quality rules as weak supervision: each rule votes good or bad or abstains, and the votes are weighed.

The counts behind the rules come from one scan of whole texts. Expectation-maximisation then fits, from
how often each pattern of votes occurs in the whole corpus, the share of good documents and what each
rule tends to say of good and of bad ones; no labels are used. A document is kept if its posterior
probability of being good reaches the threshold. Patterns are at most three to the power of the number
of rules, whatever the corpus holds, so only their counts reach the driver.

Results by case: a null or blank text has no words and fails the base; an empty table gives an empty
result; rows that repeat a ``doc_id`` are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelry.llm import textscan
from parcelry.llm.common import plain, stage

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks"]
GOOD, ABSTAIN, BAD = 2, 1, 0
IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[list(SYMBOLS.encode())] = True
IS_UPPER = np.zeros(256, dtype=bool)
IS_UPPER[65:91] = True
IS_LETTER = IS_UPPER.copy()
IS_LETTER[97:123] = True
IS_MARK = np.zeros(256, dtype=bool)
IS_MARK[list(b"!?")] = True
BEGINS_CHARACTER = (np.arange(256) & 0xC0) != 0x80
NOT_NEWLINE = np.zeros(256, dtype=bool)
NOT_NEWLINE[10] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    running = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=running[1:])
    return running[offsets[1:]] - running[offsets[:-1]]


def repeated_words(hashes: np.ndarray, bounds: np.ndarray, width: int = 3) -> np.ndarray:
    """For each row, the words inside windows of ``width`` words that occur at least twice in it."""
    whole, joined = textscan.windows(hashes, bounds, width)
    counts = np.zeros(len(bounds) - 1, dtype=np.int64)
    for row in range(len(counts)):
        a, b = int(bounds[row]), int(bounds[row + 1])
        if b - a < width + 1:
            continue
        own = joined[a : b - width + 1]
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            continue
        twice = np.zeros(len(own) + 1, dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(b - a, dtype=bool)
        for k in range(width):
            covered[k : k + len(own)] |= twice[:-1]
        counts[row] = covered.sum()
    return counts


def repeated_lines(piece: textscan.Piece, found: textscan.Spans, powers: textscan.Powers) -> tuple[np.ndarray, np.ndarray]:
    """For each row, its lines with a word, and how many of them equal an earlier one."""
    lines = textscan.words(piece, NOT_NEWLINE)
    filled = np.searchsorted(found.starts, lines.ends) > np.searchsorted(found.starts, lines.starts)
    hashes = textscan.span_hashes(piece, lines, powers)
    total, repeated = np.zeros(piece.rows, dtype=np.int64), np.zeros(piece.rows, dtype=np.int64)
    for row in range(piece.rows):
        a, b = int(lines.bounds[row]), int(lines.bounds[row + 1])
        own = hashes[a:b][filled[a:b]]
        total[row] = len(own)
        if len(own) > 1:
            repeated[row] = len(own) - len(np.unique(own))
    return total, repeated


def scan(column: pa.Array, powers: textscan.Powers) -> list[np.ndarray]:
    """The columns of COUNTS for a batch of texts."""
    parts: list[list[np.ndarray]] = []
    for piece in textscan.pieces(column):
        found = textscan.words(piece)
        hashes = textscan.span_hashes(piece, found, powers)
        lines, repeated = repeated_lines(piece, found, powers)
        data, at = piece.data, piece.offsets
        parts.append([
            np.diff(found.bounds), _per_row(BEGINS_CHARACTER[data] & ~textscan.IS_SPACE[data], at), _per_row(IS_SYMBOL[data], at), repeated,
            repeated_words(hashes, found.bounds), lines, _per_row(IS_UPPER[data], at), _per_row(IS_LETTER[data], at), _per_row(IS_MARK[data], at),
        ])
    return [np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)]


def counted(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the columns of COUNTS after its own, in place: rows stay in their tasks."""
    at, names = docs.columns.index(text), [prefix + c for c in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = textscan.Powers()
        for batch in batches:
            if batch.num_rows:
                made = map(pa.array, scan(batch.column(at), powers))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    schema = T.StructType(docs.schema.fields + [T.StructField(c, T.LongType()) for c in names])
    return docs.mapInArrow(run, schema)


def count_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, the columns of COUNTS), staged."""
    made = counted(plain(docs, key, text)).select("doc_id", *COUNTS)
    return stage(made, "quality-counts")


#: For each rule, when it votes bad, and when, if it doesn't, it votes good. Bars are in whole numbers, so that
#: every engine decides alike. Rules look at different sides of a text, as the fit takes their errors to be independent.
RULES = {
    "length": ("n_words < 20", "n_words >= 100"),
    "word_length": ("n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)", "word_chars BETWEEN 3 * n_words AND 9 * n_words"),
    "symbols": ("10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "lines": ("n_lines > 3 AND 2 * n_dup_lines > n_lines", "n_lines > 3 AND 20 * n_dup_lines <= n_lines"),
    "repeats": ("10 * n_repeat_words > 4 * n_words", "n_words >= 20 AND 5 * n_repeat_words <= n_words"),
    "shouting": ("n_words > 3 AND (2 * n_upper > n_letters OR 5 * n_marks > n_words)", "5 * n_upper <= n_letters AND 50 * n_marks <= n_words"),
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def condition(sql: str, prefix: str = "") -> Column:
    """A rule's condition over columns of COUNTS that carry a prefix."""
    return F.expr(re.sub(r"\b(n_\w+|word_chars)\b", lambda m: f"`{prefix}{m[1]}`", sql))


def pattern(prefix: str = "") -> Column:
    """The votes of a row as one number in base three, the first rule's the lowest digit."""
    total = F.lit(0)
    for k, (bad, good) in enumerate(RULES.values()):
        vote = F.when(condition(bad, prefix), BAD).when(condition(good, prefix), GOOD).otherwise(ABSTAIN)
        total = total + vote * 3**k
    return total.cast("int")


class Weights:
    """The share of good documents and, for each rule, how likely its vote is bad when it votes, by class.

    An abstention says nothing. Documents are taken to be bad in few ways at a time: to most rules a bad
    document looks good, so before any is seen a vote for bad weighs far more than one for good.
    """

    def __init__(self, rules: int) -> None:
        self.good = 0.7
        self.says_bad = np.tile(np.array([[0.3], [FALSE_ALARMS]]), (1, rules))

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        """The chance that each row of votes is of a good document."""
        logs = [((cast == BAD) * np.log(p) + (cast == GOOD) * np.log1p(-p)).sum(axis=1) for p in self.says_bad]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - self.good) / self.good), -700, 700)))

    def accuracy(self) -> np.ndarray:
        """Each rule's chance to be right when it votes."""
        return (1 - self.good) * self.says_bad[0] + self.good * (1 - self.says_bad[1])


#: What is believed of a rule before any document is seen, as so many votes; it decides when there are few documents.
PRIOR_VOTES = 5.0
#: Bars are set so far out that a rule votes bad on at most this share of good documents. Without that bound the
#: fit may spend its second class on the commonest kind of junk and count all other kinds as good.
FALSE_ALARMS = 0.005


def fitted(counts: dict[int, int], rules: int, rounds: int = 200, close: float = 1e-9) -> Weights:
    """Expectation-maximisation over the counts of vote patterns."""
    weights = Weights(rules)
    first = weights.says_bad.copy()
    if not counts:
        return weights
    codes = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[int(c)] for c in codes], dtype=float)
    cast = codes[:, None] // 3 ** np.arange(rules) % 3
    for _ in range(rounds):
        good = weights.posterior(cast)
        says_bad = first.copy()
        for c, share in enumerate((n * (1 - good), n * good)):
            bad, voted = ((share[:, None] * (cast == BAD)).sum(axis=0), (share[:, None] * (cast != ABSTAIN)).sum(axis=0))
            says_bad[c] = (bad + first[c] * PRIOR_VOTES) / (voted + PRIOR_VOTES)
        says_bad[1] = np.minimum(says_bad[1], FALSE_ALARMS)
        share = float(((n * good).sum() + 0.7 * PRIOR_VOTES) / (n.sum() + PRIOR_VOTES))
        moved = max(abs(share - weights.good), np.abs(says_bad - weights.says_bad).max())
        weights.says_bad, weights.good = says_bad, share
        if moved < close:
            break
    return weights


def fit_weights(counts: DataFrame) -> Weights:
    """Fits the rules' weights to a table of COUNTS. At most 3 ** rules rows reach the driver."""
    rows = counts.groupBy(pattern().alias("pattern")).agg(F.count("*").alias("n")).collect()
    return fitted({r["pattern"]: r["n"] for r in rows}, len(RULES))


def posteriors(spark: SparkSession, weights: Weights) -> DataFrame:
    """(_pattern, _posterior) for each of the 3 ** rules patterns: a table of fixed size, to be broadcast."""
    codes = np.arange(3 ** len(RULES))
    chance = weights.posterior(codes[:, None] // 3 ** np.arange(len(RULES)) % 3)
    rows = list(zip(codes.tolist(), chance.tolist(), strict=True))
    return F.broadcast(spark.createDataFrame(rows, "_pattern int, _posterior double").coalesce(1))


def quality_verdicts(docs: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, the columns of COUNTS, base_failed, posterior, kept) for every row of ``docs``."""
    counts = count_table(docs, key, text)
    known = posteriors(docs.sparkSession, fit_weights(counts))
    failed, chance = condition(BASE_FAILED), F.col("_posterior")
    return counts.join(known, pattern() == F.col("_pattern")).select(
        "doc_id", *COUNTS, failed.alias("base_failed"), chance.alias("posterior"), (~failed & (chance >= threshold)).alias("kept")
    )


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, columns as they are. Texts aren't shuffled: each row is judged where it is."""
    known = posteriors(docs.sparkSession, fit_weights(count_table(docs)))
    prefix = "_rules_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    rows = counted(docs, "text", prefix).where(~condition(BASE_FAILED, prefix))
    good = known.where(F.col("_posterior") >= threshold).select("_pattern")
    return rows.join(F.broadcast(good), pattern(prefix) == good["_pattern"], "left_semi").select(*[f"`{c}`" for c in docs.columns])
