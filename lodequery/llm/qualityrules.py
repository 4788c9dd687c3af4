"""Quality rules as weak supervision: rules vote or abstain, and their accuracies come from how they agree.

A pass over the texts takes each one's signals (counts of words, symbols, repeats and so on).
Rules are SQL conditions on the signals: a text may be voted good (1), bad (-1), or neither
(0).  Votes don't depend on order, so all there is to know about the corpus is how many texts
have each pattern of votes; Spark counts those, 3 ** rules at most.  Expectation-maximisation on
the counts then estimates, without labels, the share of good texts and for each rule two accuracies: how
often its vote is right on good texts, and on bad ones.  A text's posterior probability of being good
is a sum of log ratios of its votes, again a column expression; it takes the place of "must pass every rule".
Agreement is all the evidence there is: a common kind of bad text that only one rule tells may pass for that rule's errors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .wordhash import BLANK, U64, cut_rows, mix, text_bytes, window_hashes

#: Bytes of text taken at once.
SLICE = 1 << 20
#: Words of a window that is looked for again.
WINDOW = 5


def _byte_table(which) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(which)] = 1
    return table


_SYMBOL, _UPPER, _LOWER, _MARK = _byte_table(b"#*$%&|<>"), _byte_table(range(65, 91)), _byte_table(range(97, 123)), _byte_table(b".,;:!?'\")")
_CHARACTER = _byte_table([k for k in range(256) if BLANK[k] and not 0x80 <= k < 0xC0])  # begins a code point of a word
_TELLING = _byte_table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])  # letters, digits and whatever isn't ASCII

SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_telling_words", "n_upper", "n_lower", "n_shouts", "n_plain_ends", "n_doubled")


def _per_text(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of x between neighbouring bounds."""
    out, full = np.zeros(len(bounds) - 1, np.int64), np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.add.reduceat(x, bounds[full], dtype=np.int64)
    return out


def _pieces(lists: pa.Array, keep) -> tuple[pa.Array, np.ndarray]:
    """The items of lists that keep(items) takes, and which list each is from."""
    items = lists.flatten()
    own = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    kept = keep(items)
    return items.filter(kept), own[kept.to_numpy(zero_copy_only=False)]


def _numbered(items: pa.Array) -> np.ndarray:
    """Equal items get equal numbers."""
    return items.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def signals(texts: pa.Array) -> dict[str, np.ndarray]:
    """SIGNALS of every text; null counts as empty.

    Words are runs of anything but ASCII blanks, in the case they are in.  n_dup_lines: lines with a word that equal
    an earlier line of the text.  n_repeat_words: words in windows of WINDOW words that the text has twice or more.
    n_telling_words: words with a letter or digit; n_shouts: words that end in "!!"; n_plain_ends: words that end in
    a letter or digit, or in one and a single punctuation mark; n_doubled: words like the one before.  Whatever isn't ASCII passes for a letter.
    """
    texts = pc.fill_null(texts, "")
    data, offs = text_bytes(texts)
    n = len(texts)
    words, text = _pieces(pc.ascii_split_whitespace(texts), lambda x: pc.greater(pc.binary_length(x), 0))
    n_words = np.bincount(text, minlength=n).astype(np.int64)
    word_bytes, word_offs = text_bytes(words)
    shouts = pc.ends_with(words, "!!").to_numpy(zero_copy_only=False)
    last, second = word_bytes[word_offs[1:] - 1], word_bytes[np.maximum(word_offs[1:] - 2, word_offs[:-1])]
    plain = (_TELLING[last] | (_MARK[last] & _TELLING[second])).astype(bool)

    change = np.zeros(len(words) + 1, np.int64)
    numbers = _numbered(words)
    doubled = np.flatnonzero((numbers[1:] == numbers[:-1]) & (text[1:] == text[:-1])) + 1
    hashes = window_hashes(mix(numbers.astype(U64)), WINDOW)
    inside = np.flatnonzero(text[: len(hashes)] == text[WINDOW - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    _, which, times = np.unique(mix(hashes[inside] + text[inside].astype(U64) * U64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    again = inside[times[which.reshape(-1)] > 1]
    change[again] += 1
    np.add.at(change, again + WINDOW, -1)

    lines, line_text = _pieces(pc.split_pattern(texts, "\n"), lambda x: pc.match_substring_regex(x, r"[^\x20\x09-\x0D]"))
    n_lines = np.bincount(line_text, minlength=n).astype(np.int64)
    pairs = np.stack([line_text, _numbered(lines)], axis=1)
    distinct = np.bincount(np.unique(pairs, axis=0)[:, 0], minlength=n) if len(pairs) else 0
    return {
        "n_words": n_words, "word_chars": _per_text(_CHARACTER[data], offs), "n_symbols": _per_text(_SYMBOL[data], offs), "n_dup_lines": n_lines - distinct,
        "n_repeat_words": np.bincount(text[np.cumsum(change[:-1]) > 0], minlength=n).astype(np.int64), "n_lines": n_lines,
        "n_telling_words": np.bincount(text[_per_text(_TELLING[word_bytes], word_offs) > 0], minlength=n).astype(np.int64),
        "n_upper": _per_text(_UPPER[data], offs), "n_lower": _per_text(_LOWER[data], offs), "n_shouts": np.bincount(text[shouts], minlength=n).astype(np.int64),
        "n_doubled": np.bincount(text[doubled], minlength=n).astype(np.int64), "n_plain_ends": np.bincount(text[plain], minlength=n).astype(np.int64),
    }


class Rule(NamedTuple):
    """SQL conditions on the signals; a text that meets neither gets no vote, one that meets both is voted bad."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 10", "n_words >= 30"),
    Rule("repetition", "100 * n_repeat_words > 20 * n_words", "n_words >= 10 and 100 * n_repeat_words <= 5 * n_words"),
    Rule("doubles", "n_words >= 10 and 100 * n_doubled > 15 * n_words", "n_words >= 10 and 100 * n_doubled <= 3 * n_words"),
    Rule("lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines", "n_lines >= 2 and n_dup_lines = 0"),
    Rule("symbols", "100 * n_symbols > 5 * word_chars", "n_words > 0 and 100 * n_symbols <= word_chars"),
    Rule("word_length", "n_words >= 5 and (word_chars < 2 * n_words or word_chars > 20 * n_words)", "word_chars between 3 * n_words and 12 * n_words and n_words > 0"),
    Rule("telling_words", "n_words >= 5 and 100 * n_telling_words < 80 * n_words", "n_words >= 5 and 100 * n_telling_words >= 95 * n_words"),
    Rule("endings", "n_words >= 5 and 100 * n_plain_ends < 75 * n_words", "n_words >= 5 and 100 * n_plain_ends >= 95 * n_words"),
    Rule("capitals", "n_upper + n_lower >= 20 and 100 * n_upper > 40 * (n_upper + n_lower)", "n_upper + n_lower >= 20 and 100 * n_upper <= 20 * (n_upper + n_lower)"),
    Rule("shouts", "n_words >= 5 and 100 * n_shouts > 20 * n_words", "n_words >= 5 and 100 * n_shouts <= 2 * n_words"),
)


def votes(rules: tuple[Rule, ...]) -> list[Column]:
    return [F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0).alias(f"vote_{r.name}") for r in rules]


class Accuracies(NamedTuple):
    """The share of good texts; of each rule's votes on good texts, and on bad ones, how many are right."""

    share: float
    on_good: np.ndarray
    on_bad: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) for rows of votes."""
        up, down = patterns == 1, patterns == -1
        good = np.log(self.share) + up @ np.log(self.on_good) + down @ np.log(1 - self.on_good)
        bad = np.log(1 - self.share) + up @ np.log(1 - self.on_bad) + down @ np.log(self.on_bad)
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


#: What is assumed before any text is seen, with the weight of PRIOR texts.
START = Accuracies(0.5, 0.999, 0.3)
PRIOR = 10.0


def estimate(patterns: np.ndarray, counts: np.ndarray, *, steps: int = 500, settled: float = 1e-10) -> Accuracies:
    """Expectation-maximisation on numbers of texts by their votes.

    Votes are taken to be independent given whether the text is good, and abstaining to say nothing.  A rule's
    votes are never held against their own sense: a bad vote is at least as likely on bad texts as on good ones.
    """
    n_rules = patterns.shape[1]
    now = Accuracies(START.share, np.full(n_rules, START.on_good), np.full(n_rules, START.on_bad))
    up, down, counts = patterns == 1, patterns == -1, counts.astype(float)
    for _ in range(steps):
        p = now.posterior(patterns)
        good, bad = counts * p, counts * (1 - p)
        share = (good.sum() + PRIOR * START.share) / (counts.sum() + PRIOR)
        on_good = np.clip((good @ up + PRIOR * START.on_good) / (good @ (up | down) + PRIOR), 0.5, 1 - 1e-6)
        on_bad = np.clip((bad @ down + PRIOR * START.on_bad) / (bad @ (up | down) + PRIOR), 1 - on_good, 1 - 1e-6)
        moved = max(abs(share - now.share), np.abs(on_good - now.on_good).max(initial=0), np.abs(on_bad - now.on_bad).max(initial=0))
        now = Accuracies(float(share), on_good, on_bad)
        if moved < settled:
            break
    return now


def fit_accuracies(voted: DataFrame, rules: tuple[Rule, ...]) -> Accuracies:
    """From all rows of a frame with the columns of votes()."""
    names = [f"vote_{r.name}" for r in rules]
    got = voted.groupBy(*names).count().orderBy(*names).collect()  # 3 ** rules rows at most
    return estimate(np.asarray([r[:-1] for r in got], int).reshape(len(got), len(rules)), np.asarray([r["count"] for r in got], float))


def posterior(accuracies: Accuracies, rules: tuple[Rule, ...]) -> Column:
    """P(good) as an expression on the columns of votes()."""
    odds = F.lit(math.log(accuracies.share / (1 - accuracies.share)))
    for r, a, b in zip(rules, accuracies.on_good.tolist(), accuracies.on_bad.tolist()):
        v = F.col(f"vote_{r.name}")
        odds = odds + F.when(v == 1, math.log(a / (1 - b))).when(v == -1, math.log((1 - a) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def text_signals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, SIGNALS) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in cut_rows(batches, SLICE):
            t = t.combine_chunks()
            ids, texts = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns)
            found = signals(texts)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[s], pa.int64()) for s in SIGNALS)], names=["id", *SIGNALS])
        store.release_memory()

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{s} long" for s in SIGNALS))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, cut: float = 0.5, accuracies: Accuracies | None = None) -> DataFrame:
    """Per row: the id, SIGNALS (the first five are the base counts), base_failed, the votes, p_good, kept.

    base_failed: under 10 words, or over a fifth of them in repeated windows; kept: not base_failed, and p_good >= cut.
    Null and empty texts have no words and fail; null ids stay null, repeated rows are judged each and count each in the
    estimate; an empty table gives an empty result; other columns don't matter.  Accuracies from another corpus may be given.
    """
    spark = docs.sparkSession
    folder = store.new_folder(spark, "qualityrules")
    seen = text_signals(docs, id_col, text_col)
    seen.write.parquet(f"{folder}/signals")  # a few numbers a text, so texts are read once
    voted = spark.read.schema(seen.schema).parquet(f"{folder}/signals").select("*", *votes(rules))
    accuracies = accuracies or fit_accuracies(voted, rules)
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    out = voted.withColumn("base_failed", failed).withColumn("p_good", posterior(accuracies, rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= cut)).withColumnRenamed("id", id_col)
