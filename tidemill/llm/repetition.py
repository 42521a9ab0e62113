"""Repetition rule: a suffix array of each text's words finds its maximal repeated substrings.

Neighbours in the suffix array with a common prefix of `least` words or more form LCP intervals. The
intervals' common prefixes are the maximal repeats; the union of all their places is the covered part.
A text is dropped if repeats cover too much of it, or if one is too long. All texts of a task's slice
share one array; each has word numbers and an end of its own, so no repeat crosses texts.

Defined results
* null and empty texts have no words, nothing covered, and fail the base rule (too few words).
* repeated rows and null ids each give a row; other columns are ignored; an empty table gives an
  empty result. Equal suffixes cannot tie: each text has its own end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_map, text_bytes
from .suffix_array import common_prefixes, suffix_array

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


def _counter(members: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are members."""
    total = np.concatenate(([0], np.cumsum(members[data])))
    return total[offsets[1:]] - total[offsets[:-1]]


def _table(chosen: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chosen)] = True
    return t


_SYMBOL = _table(SYMBOLS)
#: First bytes of code points other than white space.
_LETTER = ~_table(b" \t\n\x0b\x0c\r") & ~_table(bytes(range(0x80, 0xC0)))


def repeats(words: list[list[bytes]], least: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each length in `least`: words of each text within repeats at least so long; then, for the
    first length, each text's longest repeat and its number of LCP intervals."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    n = int(counts.sum()) + len(words)
    ids = np.empty(n, np.int64)
    at = base = 0
    for text in words:
        numbers = {w: i for i, w in enumerate(dict.fromkeys(text), base)}
        base += len(numbers) + 1
        ids[at : at + len(text)] = np.fromiter(map(numbers.__getitem__, text), np.int64, len(text))
        ids[at + len(text)] = base - 1
        at += len(text) + 1
    order, ranks = suffix_array(ids, keep_ranks=True)
    common = common_prefixes(order, ranks, min(least))
    nearest = np.maximum(common, np.concatenate((common[1:], [0]))) if n else common
    longest_at = np.empty(n, np.int64)
    longest_at[order] = nearest
    text_of = np.repeat(np.arange(len(words)), counts + 1)
    covered = []
    for length in least:
        start = np.flatnonzero(longest_at >= length)
        depth = np.zeros(n + 1, np.int64)
        depth[start] += 1
        np.add.at(depth, start + longest_at[start], -1)
        covered.append(np.bincount(text_of[np.cumsum(depth[:-1]) > 0], minlength=len(words)))
    longest = np.zeros(len(words), np.int64)
    np.maximum.at(longest, text_of, np.where(longest_at >= least[0], longest_at, 0))
    begins = (common >= least[0]) & (np.concatenate(([0], common[:-1])) < least[0])
    intervals = np.bincount(text_of[order[begins]], minlength=len(words))
    return covered, longest, intervals


_OUT = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_words long, longest_repeat long, n_repeats long, kept boolean"


def repetition_rule(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_repeat: int = 10,
    max_covered: float = 0.15,
    max_longest: int = 50,
    base_window: int = 5,
    base_percent: int = 20,
    base_words: int = 10,
) -> DataFrame:
    """One row per row of docs: the base counts, covered_words and longest_repeat (of repeats of at least
    least_repeat words), n_repeats, and kept."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        words = [t.split() for t in texts]
        n_words = np.fromiter(map(len, words), np.int64, len(words))
        lines = []
        for t in texts:
            own = [x for x in t.split(b"\n") if x.strip()]
            lines.append(len(own) - len(set(own)))
        (covered, window), longest, intervals = repeats(words, (least_repeat, base_window))
        failed = (n_words < base_words) | (100 * window > base_percent * n_words)
        kept = ~failed & (covered <= max_covered * n_words) & (longest <= max_longest)
        columns = [n_words, _counter(_LETTER, data, offsets), _counter(_SYMBOL, data, offsets), np.array(lines, np.int64), window, failed, covered, longest, intervals, kept]
        return pa.record_batch([batch.column(0), *map(pa.array, columns)], names=[f.split()[0] for f in _OUT.split(", ")])

    base = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return arrow_map(base, run, _OUT, "text").withColumnRenamed("id", id_column)
