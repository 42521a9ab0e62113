"""Benchmark decontamination with suffix arrays of the training text.

Each task builds, for each slice of its documents (a shard), the suffix array of the shard's words and
binary-searches the benchmark's suffixes in it: the places that begin with a suffix's first `window` words are one
range of the array. The benchmark's places of such a window are in the order of their own suffixes, so the longest
verbatim match of a place is that with one of the two suffixes beside it. What cannot match is left out on both
sides: suffixes of the shard where fewer words in a row are known to the benchmark than the shortest window
has, and windows with two words in a row that the shard lacks, found by their rarest pair of words.

The benchmark goes to all tasks in parts of bounded size (BROADCAST_BYTES of text each, measured
beforehand); a larger benchmark takes several passes, and after each TOGETHER of them what is found so far is
written out and their parts are given up, so tasks and driver never hold more. No shuffle is needed.

Defined results
* null and empty texts have no words and no hits; items without words have no windows.
* a null item id counts as the empty string; repeated items count once, repeated documents each.
* other columns are ignored; an empty table gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_map, checkpoint, chunks, free_name, small_batches, text_bytes
from .suffix_array import suffix_array

#: Benchmark text that is sent to the tasks at a time.
BROADCAST_BYTES = 8 << 20
#: Parts of the benchmark that are in use at a time.
TOGETHER = 4


def _letters() -> bytes:
    """Maps each byte: A-Z to lower case; digits, a-z and all bytes of other scripts stay; the rest ends words."""
    out = bytearray(b" " * 256)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        out[b] = b
    for b in range(0x41, 0x5B):
        out[b] = b + 32
    return bytes(out)


_LETTERS = _letters()


def words(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


@dataclass
class Suffixes:
    """A part of the benchmark: its vocabulary, its windows, and all places of each window in the order of their suffixes."""

    numbers: dict[bytes, int]
    stream: np.ndarray  # all items' word numbers, 0 after each
    size: np.ndarray  # words of each different window
    place_from: np.ndarray  # place[place_from[w] : place_from[w + 1]] are where window w begins in the stream
    place: np.ndarray
    rest: np.ndarray  # words from a place to the end of its item
    owner: np.ndarray  # number of a place's item
    offset: np.ndarray  # of a place in its item
    item_from: np.ndarray  # items[item_from[w] : item_from[w + 1]] have window w
    items: np.ndarray
    names: list[str]
    rare_keys: np.ndarray | None = None  # of the benchmark's pairs of words those that are a window's rarest
    rare_from: np.ndarray | None = None  # rare[rare_from[n] : rare_from[n + 1]] are the windows whose rarest pair is rare_keys[n]
    rare: np.ndarray | None = None

    @property
    def start(self) -> np.ndarray:
        """One place of each window."""
        return self.place[self.place_from[:-1]]

    def key(self, at: np.ndarray, k: int) -> np.ndarray:
        """The k-th pair of words of the windows that begin at `at`; a window of one word has that word and nothing."""
        base = len(self.numbers) + 1
        second = np.where(k + 1 < self.size[at], self.stream[np.minimum(self.start[at] + k + 1, len(self.stream) - 1)], 0)
        return self.stream[np.minimum(self.start[at] + k, len(self.stream) - 1)] * base + second

    def possible(self, stream: np.ndarray) -> np.ndarray:
        """The windows all of whose pairs of words are in a shard's stream; only those whose rarest pair is there are looked at."""
        base, both = len(self.numbers) + 1, (stream[:-1] > 0) & (stream[1:] > 0)
        there = np.unique(np.concatenate((stream[:-1][both] * base + stream[1:][both], np.unique(stream[stream > 0]) * base)))
        at = np.searchsorted(self.rare_keys, there)
        at = at[self.rare_keys[np.minimum(at, len(self.rare_keys) - 1)] == there]
        sizes = self.rare_from[at + 1] - self.rare_from[at]
        found = self.rare[np.repeat(self.rare_from[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        for k in range(int(self.size.max(initial=0)) - 1):
            key = self.key(found, k)
            place = np.minimum(np.searchsorted(there, key), len(there) - 1)
            found = found[(self.size[found] <= k + 1) | (there[place] == key)]
        return np.sort(found)


def _lists(of: np.ndarray, values: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """values by `of`, and where each one's begin; both sorted, each pair once."""
    pairs = np.unique(of * (int(values.max(initial=0)) + 1) + values)
    of, values = np.divmod(pairs, int(values.max(initial=0)) + 1)
    return np.searchsorted(of, np.arange(count + 1)), values


def prepare(items: list[tuple[object, str | None]], window: int) -> Suffixes:
    numbers: dict[bytes, int] = {}
    names: dict[str, int] = {}
    texts: list[np.ndarray] = []
    owners: list[int] = []
    for name, text in sorted(("" if item is None else str(item), text or "") for item, text in items):
        own = words(text.encode())
        if own:
            texts.append(np.array([numbers.setdefault(w, len(numbers) + 1) for w in own], np.int64))
            owners.append(names.setdefault(name, len(names)))
    lengths = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate(([0], np.cumsum(lengths + 1)))
    stream = np.zeros(int(base[-1]) + 1, np.int64)
    for t, at in zip(texts, base.tolist()):
        stream[at : at + len(t)] = t
    owner = np.repeat(np.array(owners, np.int64), lengths + 1)
    offset = np.arange(base[-1]) - np.repeat(base[:-1], lengths + 1)
    rest = np.repeat(lengths, lengths + 1) - offset
    # windows of whole length are runs of the suffix array that share their first words
    order, _ = suffix_array(stream[: base[-1]])
    order = order[rest[order] >= window]
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in range(window):
        new[1:] |= stream[order[1:] + k] != stream[order[:-1] + k]
    # shorter items are one window each
    short: dict[bytes, list[int]] = {}
    for t, at in zip(texts, base.tolist()):
        if len(t) < window:
            short.setdefault(t.tobytes(), []).append(at)
    place = np.concatenate((order, np.array([x for own in short.values() for x in own], np.int64)))
    counts = np.concatenate((np.diff(np.concatenate((np.flatnonzero(new), [len(order)]))), np.array([len(x) for x in short.values()], np.int64)))
    place_from = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    size = np.full(len(counts), window, np.int64)
    size[len(counts) - len(short) :] = [len(k) // 8 for k in short]
    item_from, item = _lists(np.repeat(np.arange(len(counts)), counts), owner[place], len(counts))
    s = Suffixes(numbers, stream, size, place_from, place, rest[place], owner[place], offset[place], item_from, item, list(names))
    every = np.arange(len(size))
    pairs = stream[:-1] * (len(numbers) + 1) + stream[1:]
    pairs, often = np.unique(pairs, return_counts=True)
    count = lambda key: often[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)]
    rarest = s.key(every, 0)
    for k in range(1, window - 1):
        own = np.where(size > k + 1, s.key(every, k) if len(every) else every, rarest)
        rarest = np.where(count(own) < count(rarest), own, rarest)
    s.rare_keys, which = np.unique(rarest, return_inverse=True)
    s.rare_from, s.rare = _lists(which, every, len(s.rare_keys))
    return s


def _compare(stream: np.ndarray, at: np.ndarray, tests: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common words of stream[at:] and tests[start : start + length], and the sign of their difference
    (0: all `length` words are common)."""
    common, sign = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    open_, k = np.arange(len(at)), 0
    while (open_ := open_[length[open_] > k]).size:
        a = at[open_] + k
        x = np.where(a < len(stream), stream[np.minimum(a, len(stream) - 1)], 0)
        y = tests[start[open_] + k]
        common[open_] += x == y
        sign[open_] = np.sign(x - y)
        open_, k = open_[x == y], k + 1
    return common, sign


def search(order: np.ndarray, stream: np.ndarray, s: Suffixes, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the windows the range of the suffix array whose suffixes begin with it."""
    edges, start, size = [], s.start[windows], s.size[windows]
    for after in (False, True):
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            _, sign = _compare(stream, order[mid], s.stream, start[open_], size[open_])
            up = sign <= 0 if after else sign < 0
            low[open_], high[open_] = np.where(up, mid + 1, low[open_]), np.where(up, high[open_], mid)
        edges.append(low)
    return edges[0], edges[1]


def _longest(stream: np.ndarray, at: np.ndarray, s: Suffixes, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest match of stream[at:] with any place of its window, and that place.

    A window's places are in the order of their suffixes: the two beside where stream[at:] belongs have the longest prefix."""
    low, high = s.place_from[window], s.place_from[window + 1]
    first, last = low.copy(), high.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) >> 1
        _, sign = _compare(stream, at[open_], s.stream, s.place[mid], s.rest[mid])
        low[open_], high[open_] = np.where(sign >= 0, mid + 1, low[open_]), np.where(sign >= 0, high[open_], mid)
    before, behind = np.maximum(low - 1, first), np.minimum(low, last - 1)
    x, _ = _compare(stream, at, s.stream, s.place[before], s.rest[before])
    y, _ = _compare(stream, at, s.stream, s.place[behind], s.rest[behind])
    return np.maximum(x, y), np.where(y > x, behind, before)


def _matches(texts: list[list[bytes]], s: Suffixes, whole: bool = True) -> tuple[np.ndarray, ...]:
    """Occurrences of windows in a shard: text, first word, words, window; with `whole`, the longest match there and its place."""
    none = (np.zeros(0, np.int64),) * 6
    if not len(s.size):
        return none
    known = s.numbers.get
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    ids = np.zeros(int(counts.sum()) + len(texts) + 1, np.int64)
    at = 0
    for t in texts:
        ids[at : at + len(t)] = np.fromiter(map(known, t, repeat(0)), np.int64, len(t))
        at += len(t) + 1
    # runs of known words that are long enough for a window, each followed by one 0
    edge = np.diff(np.concatenate(([0], (ids > 0).astype(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    fit = end - begin >= s.size.min()
    begin, size = begin[fit], (end - begin)[fit] + 1
    if not len(begin):
        return none
    last = np.cumsum(size)
    origin = np.repeat(begin - (last - size), size) + np.arange(last[-1])
    stream = ids[np.minimum(origin, len(ids) - 1)]
    stream[last - 1] = 0
    windows = s.possible(stream)
    if not len(windows):
        return none
    order, _ = suffix_array(stream, depth=int(s.size.max()))
    low, high = search(order, stream, s, windows)
    times = high - low
    window = np.repeat(windows, times)
    if not len(window):
        return none
    place = order[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(len(window))]
    longest, there = _longest(stream, place, s, window) if whole else (s.size[window], s.place_from[window])
    first = origin[place]
    base = np.concatenate(([0], np.cumsum(counts + 1)))
    text = np.searchsorted(base, first, side="right") - 1
    return text, first - base[text], s.size[window], window, longest, there


_MATCH = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item", pa.string()), ("item_start", pa.int32())])
_HITS = "n_words long, hits array<struct<start: int, end: int>>, items array<string>, matches array<struct<start: int, end: int, item: string, item_start: int>>"


def _maximal(text: np.ndarray, start: np.ndarray, longest: np.ndarray, there: np.ndarray, s: Suffixes) -> Iterator[tuple[int, dict]]:
    """The occurrences' longest matches, without those inside the one that begins a word before; an item's match once."""
    end = start + longest
    by = np.lexsort((-end, start, text))
    text, start, end, there = text[by], start[by], end[by], there[by]
    inner = np.zeros(len(text), bool)
    # of one start the longest comes first
    inner[1:] = (text[1:] == text[:-1]) & (end[1:] <= end[:-1]) & (start[1:] - start[:-1] <= 1)
    for k in np.flatnonzero(~inner).tolist():
        p = there[k]
        yield int(text[k]), {"start": int(start[k]), "end": int(end[k]), "item": s.names[s.owner[p]], "item_start": int(s.offset[p])}


def _pass(df: DataFrame, shared, first: bool) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s: Suffixes = shared.value
        data, offsets = text_bytes(batch.column("text"))
        raw = data.tobytes().translate(_LETTERS)
        texts = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        text, start, size, window, longest, there = _matches(texts, s)
        hits = [[] for _ in texts]
        items = [set() for _ in texts]
        matches = [[] for _ in texts]
        if not first:
            hits = [[(x["start"], x["end"]) for x in h] for h in batch.column("hits").to_pylist()]
            items = [set(x) for x in batch.column("items").to_pylist()]
            matches = batch.column("matches").to_pylist()
        for t, m in _maximal(text, start, longest, there, s):
            matches[t].append(m)
        for t, a, n in zip(text.tolist(), start.tolist(), size.tolist()):
            hits[t].append((a, a + n))
        pairs = {(int(t), int(w)) for t, w in zip(text, window)}
        for t, w in pairs:
            items[t].update(s.names[i] for i in s.items[s.item_from[w] : s.item_from[w + 1]])
        spans = [[{"start": a, "end": b} for a, b in _union(h)] for h in hits]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        added = [pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, kind), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(matches, pa.list_(_MATCH))]
        return pa.record_batch([batch.column("id"), batch.column("text"), *added], names=["id", "text", "n_words", "hits", "items", "matches"])

    return arrow_map(df, run, f"id long, text string, {_HITS}", "text")


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _parts(benchmark: DataFrame, item_column: str, item_text: str) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark in parts of bounded size."""
    bench = benchmark.select(F.col(item_column).alias("item"), F.col(item_text).cast("string").alias("words"))
    size = bench.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = max(1, -(-size // BROADCAST_BYTES))
    for k in range(parts):
        own = bench.where(F.pmod(F.xxhash64(F.coalesce("words", F.lit(""))), F.lit(parts)) == k).collect()
        yield [(r["item"], r["words"]) for r in own]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, hits (word spans inside windows), n_hit, items (ids as
    strings, sorted), matches (start and end in the document, an item and the word of it where the match begins), longest_match
    (words), contaminated. Matches go on from a window as far as any place of it in the benchmark allows; one that lies in the match
    beginning a word before is left out; of several items with the longest one, one is named."""
    context = docs.sparkSession.sparkContext
    df = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    used: list[Broadcast] = []
    for k, part in enumerate(_parts(benchmark, item_column, item_text)):
        df, used = _given_up(df, used)
        used.append(context.broadcast(prepare(part, window)))
        df = _pass(df, used[-1], k == 0)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda t, h: t + h["end"] - h["start"])
    longest = F.aggregate("matches", F.lit(0), lambda most, m: F.greatest(most, m["end"] - m["start"]))
    return df.select(F.col("id").alias(id_column), "n_words", "hits", n_hit.alias("n_hit"), "items", "matches", longest.alias("longest_match"), (n_hit > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs, all columns as they are, without the rows that share a window with the benchmark."""
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    used: list[Broadcast] = []
    for part in _parts(benchmark, item_column, item_text):
        docs, used = _given_up(docs, used)
        used.append(context.broadcast(prepare(part, window)))
        docs = _filter(docs, used[-1], text_column)
    return docs


def _given_up(df: DataFrame, used: list[Broadcast]) -> tuple[DataFrame, list[Broadcast]]:
    """After TOGETHER passes, df written out and the parts that it needed dropped."""
    if len(used) < TOGETHER:
        return df, used
    df = checkpoint(df)
    for x in used:
        x.destroy()
    return df, []


def _filter(docs: DataFrame, shared: Broadcast, text_column: str) -> DataFrame:
    extra = free_name(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, extra):
            data, offsets = text_bytes(batch.column(extra))
            raw = data.tobytes().translate(_LETTERS)
            texts = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            clean = np.ones(len(texts), bool)
            clean[_matches(texts, shared.value, whole=False)[0]] = False
            yield batch.drop_columns([extra]).filter(pa.array(clean))

    return docs.withColumn(extra, F.col(text_column).cast("string")).mapInArrow(run, docs.schema)
