"""Removal of byte strings that occur earlier in the corpus, by a hash-compared suffix sort.

Rule: a byte goes if a `length`-byte string covers it that also starts earlier (in a document before,
or before in the same document). Documents are ordered by id; strings never cross documents.

Sorting all suffixes of a corpus would shuffle many times its size. It is enough to sort suffixes at
*anchors*: of the `K`-byte strings within each `length`-byte window, the one with the least hash is
the window's anchor. Equal windows have equal anchors at equal places, so

1. every document is cut into anchors; (hash, place) of each goes to the task of its hash, which
   keeps those that occur twice or more (arrays in one row a task, not a row for each anchor);
2. those return to their document's task, which adds the bytes around each anchor that its windows
   span. Of equal surroundings in one task only the first place goes on, the others are done;
3. the task of an anchor's hash sorts the suffixes that begin at its places, and backwards the
   prefixes that end there, by mergesort. A comparison finds the longest common extension by binary
   search over prefix polynomial hashes, so it takes log2(length) steps; neighbours in the sorted
   order are then compared byte by byte, and a group in which a hash collided is sorted anew by
   bytes. Windows that start `o` bytes before the anchor are equal if both their halves are in one
   class, a run of neighbours with common extensions of at least `o` and `length - o` bytes. All but
   the earliest of a class are repeats;
4. the spans return to their document's task, which removes their union.

Work in each task is by numpy over all documents or groups that it holds. Nothing is collected to the
driver, and a place costs about 20 bytes whatever the size of its group.

Defined results
* null text counts as empty; an empty table gives an empty result; texts shorter than `length` stay.
* a null id comes before all others. Rows with one id are ordered by text; equal rows are copies, of
  which all but one lose what is repeated.
* columns in `keep` pass through untouched; those named like one that this adds are refused (ValueError), as
  are lengths under 1 or over MOST_LENGTH.
* very long texts are cut whole; ids in any steps spread over the tasks (their number of buckets is a prime).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import checkpoint, chunks, release, small_batches, text_bytes

#: Bytes of an anchor. A longer one recurs less by chance, a shorter one leaves fewer anchors.
K = 32
#: Text bytes in one bucket of documents, and text bytes whose anchors are in one bucket of hashes: a task
#: holds one bucket at a time.
BUCKET_BYTES = 2 << 20
HASH_BYTES = 12 << 20
#: Text bytes that go through one task at most, where the session's number of partitions would give more.
TASK_BYTES = 128 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


#: Powers are kept between calls up to this many; a longer text has its own for the time.
_KEPT = 3 << 20


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse, mod 2**64."""
    out = []
    for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
        x = np.full(size, np.uint64(base))
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


_few = lru_cache(maxsize=1)(lambda: _powers(_KEPT))


def _pow(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _few() if size <= _KEPT else _powers(size)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """s with hash of data[a:b] = (s[b] - s[a]) / _BASE**a mod 2**64."""
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letters()[data] * _pow(len(data) + 1)[0][: len(data)], out=s[1:])
    return s


def _rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of each k-byte string, put together from those of half the length."""
    one, width, power = _letters()[data], 1, int(_BASE)
    out, got = None, 0
    while True:
        if k & width:
            out = one if out is None else out[: len(data) - got - width + 1] * np.uint64(power) + one[got : got + len(data) - got - width + 1]
            got += width
        if got == k:
            return out.copy() if out is one else out
        one = one[:-width] * np.uint64(power) + one[width:]
        width, power = width * 2, power * power & ((1 << 64) - 1)


def find_anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows in each document: hash, place, first and last window start."""
    n, none = len(data), np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    if n < length or not (sizes >= length).any():
        return none.astype(np.uint64), none, none, none
    h = _rolling(data, k)
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    bits = np.uint64(int(n).bit_length())
    at = np.arange(len(h), dtype=np.uint64)
    least = ((h >> bits) << bits) | at
    span, width = length - k + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    ends = np.zeros(n + 1, np.int32)
    long = sizes >= length
    np.add.at(ends, offsets[:-1][long], 1)
    np.add.at(ends, offsets[1:][long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(ends[: len(least)]))
    place = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:], [len(start)])) - 1
    place = place[first]
    return h[place], place, start[first], start[last]


def _common(s: np.ndarray, pw: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Longest common extension of the suffixes at a and b, up to `most`, by binary search on hashes."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    sa, sb, pa_, pb = s[a], s[b], pw[a], pw[b]
    for _ in range(int(most.max(initial=0)).bit_length() + 1):
        mid = (low + high + 1) >> 1
        same = (s[a + mid] - sa) * pb == (s[b + mid] - sb) * pa_
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        high = np.maximum(high, low)
    return low


def sort_suffixes(data: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[at : at + size] within each group (group ascends), and the common
    extension of each with the one before it in the order (-1 at the first of a group).

    Bottom-up mergesort of all groups at a time: each round finds every suffix's rank in its sibling
    run by binary search."""
    m = len(at)
    s, pw = prefix_hashes(data), _pow(len(data) + 1)[0]
    padded = np.concatenate((data, np.zeros(1, np.uint8)))
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    count = np.diff(np.concatenate((begin, [m])))
    base, members = np.repeat(begin, count), np.repeat(count, count)
    inside = np.arange(m) - base
    order, width = np.arange(m), 1

    def before(x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        most = np.minimum(size[x], size[y])
        c = _common(s, pw, at[x], at[y], most)
        cx, cy = padded[at[x] + np.minimum(c, most)], padded[at[y] + np.minimum(c, most)]
        ended = c == most
        return np.where(ended, (size[x] < size[y]) | ((size[x] == size[y]) & or_equal), cx < cy)

    while (live := np.flatnonzero(members > width)).size:
        run = inside[live] // width
        pair = base[live] + (run & ~1) * width
        other = base[live] + (run ^ 1) * width
        low = np.minimum(other, base[live] + members[live])
        high = np.minimum(other + width, base[live] + members[live])
        first, left = low.copy(), (run & 1) == 0
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            # in the left run go before equals of the right run, in the right run after those of the left
            goes = before(order[mid], order[live[open_]], ~left[open_])
            low[open_] = np.where(goes, mid + 1, low[open_])
            high[open_] = np.where(goes, high[open_], mid)
        merged = order.copy()
        merged[pair + (inside[live] - run * width) + (low - first)] = order[live]
        order, width = merged, width * 2
    common = np.full(m, -1, np.int64)
    rest = np.flatnonzero(inside > 0)
    if rest.size:
        x, y = order[rest - 1], order[rest]
        common[rest] = _common(s, pw, at[x], at[y], np.minimum(size[x], size[y]))
        wrong = np.zeros(m, bool)
        for i in range(0, len(rest), 1 << 15):
            wrong[rest[i : i + (1 << 15)]] = _belied(padded, at, size, x[i : i + (1 << 15)], y[i : i + (1 << 15)], common[rest[i : i + (1 << 15)]])
        for g in np.unique(group[wrong]):
            _sort_by_bytes(data, at, size, np.flatnonzero(group == g), order, common)
    return order, common


def _belied(padded: np.ndarray, at: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Whether the bytes contradict that x and y share just `common` bytes and stand in order."""
    width = int(common.max(initial=0))
    step = np.arange(width)
    inside = step < common[:, None]
    a, b = padded[np.where(inside, at[x][:, None] + step, 0)], padded[np.where(inside, at[y][:, None] + step, 0)]
    most = np.minimum(size[x], size[y])
    more = common < most
    cx, cy = padded[at[x] + np.minimum(common, most)], padded[at[y] + np.minimum(common, most)]
    return (a != b).any(axis=1) | np.where(more, cx >= cy, size[x] > size[y])


def _sort_by_bytes(data: np.ndarray, at: np.ndarray, size: np.ndarray, members: np.ndarray, order: np.ndarray, common: np.ndarray) -> None:
    """The rare group in which a hash collided."""
    text = {int(i): data[at[i] : at[i] + size[i]].tobytes() for i in members}
    done = sorted(text, key=text.__getitem__)
    order[members] = done
    for k in range(1, len(done)):
        a, b = text[done[k - 1]], text[done[k]]
        most = min(len(a), len(b))
        differ = np.flatnonzero(np.frombuffer(a[:most], np.uint8) != np.frombuffer(b[:most], np.uint8))
        common[members[k]] = differ[0] if differ.size else most


def repeated_windows(data: np.ndarray, offsets: np.ndarray, left: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last offset o (bytes from a window's start to the anchor) of windows that are not
    the earliest of their kind. Row i holds data[offsets[i]:offsets[i+1]], the anchor left[i] bytes in;
    rows ascend by group, then by place."""
    m = len(left)
    sizes = np.diff(offsets)
    right = sizes - left
    forward, up = sort_suffixes(data, offsets[:-1] + left, right, group)
    backward, down = sort_suffixes(data[::-1].copy(), len(data) - (offsets[:-1] + left), left, group)
    widest = int(left.max(initial=0))
    repeat = np.zeros((m, widest + 1), bool)
    rc, lc = np.empty(m, np.int64), np.empty(m, np.int64)
    for o in range(widest + 1):
        has = np.flatnonzero((left >= o) & (right >= length - o))
        if has.size < 2:
            continue
        rc[forward] = np.cumsum(up < length - o)
        lc[backward] = np.cumsum(down < o)
        key = rc[has] * (m + 1) + lc[has]
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        repeat[has[by[1:][same]], o] = True
    edge = np.diff(np.pad(repeat, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


# --- what the tasks hand to one another: rows of (bucket, arrays as bytes) -------------------------

_ROW = "bucket long, part binary"
_SCHEMA = pa.schema([("bucket", pa.int64()), ("part", pa.binary())])
#: What a context's size holds.
MOST_LENGTH = 32_000


def _place(length: int) -> np.dtype:
    """A place of an anchor: its hash, row, byte in the text; the bytes from the first window's start to it, and
    those from there to the last window's start."""
    small = "u1" if length < 256 else "<u2"
    return np.dtype([("h", "<u8"), ("rid", "<i8"), ("at", "<u4"), ("left", small), ("more", small)])


_SPAN = np.dtype([("rid", "<i8"), ("start", "<u4"), ("end", "<u4")])


def _pack(bucket: np.ndarray, records: np.ndarray) -> tuple[list[int], list[bytes]]:
    by = np.argsort(bucket, kind="stable")
    bucket, records = bucket[by], records[by]
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    ends = np.concatenate((cut[1:], [len(bucket)]))
    return [int(bucket[c]) for c in cut], [records[c:e].tobytes() for c, e in zip(cut, ends)]


def _batch(bucket: list[int], part: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(bucket, pa.int64()), pa.array(part, pa.binary())], schema=_SCHEMA)


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return (x.astype(np.uint64) % np.uint64(buckets)).astype(np.int64)


def _rid_bucket(rid: np.ndarray, buckets: int) -> np.ndarray:
    return np.mod(rid, buckets)


def _prime(least: int) -> int:
    """The least prime from there on: ids in steps fill all buckets."""
    n = max(2, least)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _anchor_rows(buckets: int, length: int, k: int):
    kind = _place(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_bytes"):
            data, offsets = text_bytes(batch.column("_bytes"))
            rid = batch.column("_rid").to_numpy(zero_copy_only=False)
            h, place, low, high = find_anchors(data, offsets, length, k)
            doc = np.searchsorted(offsets, place, side="right") - 1
            out = np.empty(len(h), kind)
            out["h"], out["rid"], out["at"], out["left"], out["more"] = h, rid[doc], place - offsets[doc], place - low, high - low
            yield _batch(*_pack(_bucket(h >> np.uint64(20), buckets), out))

    return run


def _recurring_rows(buckets: int, kind: np.dtype):
    """Of the places that came together by hash, those whose hash recurs, sent to their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(b, []).append(p)
        for b in list(held):
            x = np.frombuffer(b"".join(held.pop(b)), kind)
            h = x["h"]
            by = np.argsort(h, kind="stable")
            same = h[by[1:]] == h[by[:-1]]
            twice = np.zeros(len(x), bool)
            twice[by[1:][same]] = True
            twice[by[:-1][same]] = True
            x = x[twice]
            if len(x):
                yield _batch(*_pack(_rid_bucket(x["rid"], buckets), x))
        release()

    return run


def _context_part(records: np.ndarray, size: np.ndarray, data: bytes) -> bytes:
    return len(records).to_bytes(8, "little") + records.tobytes() + size.astype("<u2").tobytes() + data


def _read_context(part: bytes, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(part[:8], "little")
    a, b = 8 + n * kind.itemsize, 8 + n * (kind.itemsize + 2)
    return np.frombuffer(part[8:a], kind), np.frombuffer(part[a:b], "<u2").astype(np.int64), np.frombuffer(part[b:], np.uint8)


def _slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all slices behind one another."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.uint8)
    return data[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]


def _context_rows(buckets: int, length: int):
    """Adds to each recurring place the bytes that its windows span. Bucket -1 holds finished spans."""

    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        got = [p for p in places.column("part").to_pylist() if p]
        if not got or not docs.num_rows:
            return _SCHEMA.empty_table()
        x = np.frombuffer(b"".join(got), _place(length))
        data, offsets = text_bytes(docs.column("_bytes").combine_chunks())
        rid = docs.column("_rid").to_numpy()
        by = np.argsort(rid)
        doc = by[np.searchsorted(rid[by], x["rid"])]
        x = x[np.lexsort((x["at"], x["rid"]))] if len(x) > 1 else x
        doc = by[np.searchsorted(rid[by], x["rid"])]
        start = offsets[doc] + x["at"].astype(np.int64) - x["left"]
        size = x["more"].astype(np.int64) + length
        s, inverse = prefix_hashes(data), _pow(len(data) + 1)[1]
        whole = (s[start + size] - s[start]) * inverse[start]
        # equal surroundings in this task: all but the first place are repeats throughout
        key = whole ^ (x["h"] * _MIX) ^ (x["left"].astype(np.uint64) << np.uint64(16)) ^ x["more"].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        head = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
        chief = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
        done = np.zeros(len(x), bool)
        for i in range(0, len(order), 1 << 15):
            a, b = chief[i : i + (1 << 15)], order[i : i + (1 << 15)]
            rest = a != b
            a, b = a[rest], b[rest]
            fit = (size[a] == size[b]) & (x["left"][a] == x["left"][b]) & (x["h"][a] == x["h"][b])
            a, b = a[fit], b[fit]
            if len(a):
                step = np.arange(int(size[a].max()))
                inside = step < size[a][:, None]
                equal = (data[np.where(inside, start[a][:, None] + step, 0)] == data[np.where(inside, start[b][:, None] + step, 0)]).all(axis=1)
                done[b[equal]] = True
        bucket, part = [], []
        if done.any():
            span = np.empty(int(done.sum()), _SPAN)
            span["rid"], span["start"] = x["rid"][done], start[done] - offsets[doc[done]]
            span["end"] = span["start"] + size[done]
            bucket.append(-1 - int(docs.column("_bucket")[0].as_py()))
            part.append(_merge(span).tobytes())
        release()
        go = np.flatnonzero(~done)
        to = _bucket(x["h"][go] >> np.uint64(20), buckets)
        by = np.argsort(to, kind="stable")
        go, to = go[by], to[by]
        cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else np.zeros(0, np.int64)
        for c, e in zip(cut, np.concatenate((cut[1:], [len(to)]))):
            one = go[c:e]
            bucket.append(int(to[c]))
            part.append(_context_part(x[one], size[one], _slices(data, start[one], size[one]).tobytes()))
        return pa.Table.from_arrays([pa.array(bucket, pa.int64()), pa.array(part, pa.binary())], schema=_SCHEMA)

    return run


def _merge(span: np.ndarray) -> np.ndarray:
    """Union of spans that touch or overlap, for each document."""
    span = span[np.lexsort((span["start"], span["rid"]))]
    if len(span) < 2:
        return span
    # ends never decrease along a document once the greatest so far is taken
    doc = np.concatenate(([0], np.cumsum(span["rid"][1:] != span["rid"][:-1])))
    reach = np.maximum.accumulate(doc * (1 << 33) + span["end"].astype(np.int64))
    new = np.concatenate(([True], doc[1:] * (1 << 33) + span["start"][1:].astype(np.int64) > reach[:-1]))
    at = np.flatnonzero(new)
    out = span[at].copy()
    out["end"] = (reach[np.concatenate((at[1:], [len(span)])) - 1] & ((1 << 33) - 1)).astype(np.uint32)
    return out


def _span_rows(buckets: int, length: int):
    kind = _place(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b < 0:
                    yield _batch([-1 - b], [p])
                else:
                    held.setdefault(b, []).append(p)
        for b in list(held):
            records, sizes, data = zip(*(_read_context(p, kind) for p in held.pop(b)))
            x, size, data = np.concatenate(records), np.concatenate(sizes), np.concatenate(data)
            by = np.lexsort((x["at"], x["rid"], x["h"]))
            h = x["h"][by]
            twice = np.zeros(len(h), bool)
            twice[1:] = h[1:] == h[:-1]
            twice[:-1] |= h[1:] == h[:-1]
            start = np.cumsum(size) - size
            by = by[twice]
            for piece in _group_slices(x["h"][by]):
                i = by[piece]
                y = x[i]
                group = np.cumsum(np.concatenate(([0], y["h"][1:] != y["h"][:-1])))
                own = np.concatenate(([0], np.cumsum(size[i])))
                row, first, last = repeated_windows(_slices(data, start[i], size[i]), own, y["left"].astype(np.int64), group, length)
                if len(row):
                    span = np.empty(len(row), _SPAN)
                    at = y["at"][row].astype(np.int64)
                    span["rid"], span["start"], span["end"] = y["rid"][row], at - last, at - first + length
                    yield _batch(*_pack(_rid_bucket(span["rid"], buckets), span))
        release()

    return run


def _group_slices(h: np.ndarray, rows: int = 1 << 14) -> Iterator[slice]:
    """Slices of about `rows` rows that keep groups whole."""
    ends = np.concatenate((np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)])) if len(h) else np.zeros(0, np.int64)
    start = 0
    while start < len(h):
        stop = int(ends[min(np.searchsorted(ends, start + rows), len(ends) - 1)])
        yield slice(start, stop)
        start = stop


def _texts(kept: pa.Array) -> pa.Array:
    """Bytes as text; bytes of characters that were cut in two go."""
    return pa.array([x.as_buffer().to_pybytes().decode("utf-8", "ignore") for x in kept], pa.string())


def _cut_rows(names: list[str], schema: pa.Schema):
    text = schema.names[-1] == "text"

    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        data, offsets = text_bytes(docs.column("_bytes").combine_chunks())
        rid = docs.column("_rid").to_numpy()
        got = [p for p in spans.column("part").to_pylist() if p]
        x = np.frombuffer(b"".join(got), _SPAN)
        by = np.argsort(rid)
        doc = by[np.searchsorted(rid[by], x["rid"])] if len(x) else np.zeros(0, np.int64)
        depth = np.zeros(len(data) + 1, np.int32)
        np.add.at(depth, offsets[doc] + x["start"], 1)
        np.add.at(depth, offsets[doc] + x["end"], -1)
        gone = np.cumsum(depth[:-1]) > 0
        count = np.concatenate(([0], np.cumsum(gone)))
        removed = count[offsets[1:]] - count[offsets[:-1]]
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        begins[inner] = gone[inner]
        stops = gone.copy()
        stops[:-1] &= ~gone[1:]
        outer = offsets[1:][offsets[1:] > 0] - 1
        stops[outer] = gone[outer]
        first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        runs = np.searchsorted(first, offsets)
        base = np.repeat(offsets[:-1], np.diff(runs))
        pair = pa.StructArray.from_arrays([pa.array(first - base), pa.array(last - base)], ["start", "end"])
        kept = offsets - count[offsets]
        left = pa.Array.from_buffers(pa.binary(), docs.num_rows, [None, pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(data[~gone])])
        del depth, gone, begins, stops
        release()
        columns = [docs.column(c).combine_chunks() for c in names]
        columns += [
            pa.array(np.diff(offsets)),
            pa.array(removed),
            pa.ListArray.from_arrays(pa.array(runs.astype(np.int32)), pair),
            _texts(left) if text else left,
        ]
        return pa.Table.from_arrays(columns, names=schema.names).cast(schema)

    return run


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 100, keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """One row per row of docs: id, the columns in `keep`, n_bytes, n_removed, spans
    array<struct<start, end>> (byte runs that went), kept (binary, what is left); with as_text, in its place
    text (what is left as a string, without the bytes of characters that were cut in two)."""
    if not 1 <= length <= MOST_LENGTH:
        raise ValueError(f"length {length}: from 1 to {MOST_LENGTH}")
    if clash := {id_column, *keep} & {"n_bytes", "n_removed", "spans", "text" if as_text else "kept", "_rid", "_bucket", "_bytes"}:
        raise ValueError(f"columns {sorted(clash)} have names that the result or its making needs")
    k = min(K, length)
    names = [id_column, *keep]
    base = docs.select(*names, F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("_bytes"))
    found = base.agg(F.sum(F.length("_bytes")).alias("bytes"), F.count("*").alias("rows"), F.countDistinct(id_column).alias("ids")).first()
    buckets = _prime(-(-(found["bytes"] or 0) // BUCKET_BYTES))
    hashes = max(1, -(-(found["bytes"] or 0) // HASH_BYTES))
    if found["rows"] == found["ids"]:
        base = base.withColumn("_rid", F.col(id_column).cast("long"))
    else:
        base = numbered(base, id_column)
    base = base.withColumn("_bucket", F.pmod("_rid", F.lit(buckets).cast("long")))
    small_batches(docs.sparkSession)
    to = max(hashes, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    anchors = base.select("_rid", "_bytes").mapInArrow(_anchor_rows(hashes, length, k), _ROW)
    recurring = anchors.repartition(to, "bucket").mapInArrow(_recurring_rows(buckets, _place(length)), _ROW)
    wide = -(-(found["bytes"] or 0) // TASK_BYTES)
    more = wide > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def meet(df: DataFrame, column: str) -> DataFrame:
        return df.repartition(wide, column) if more else df

    by_doc = meet(base, "_bucket").groupBy("_bucket")
    around = by_doc.cogroup(meet(recurring, "bucket").groupBy("bucket")).applyInArrow(_context_rows(hashes, length), _ROW)
    spans = around.repartition(to, "bucket").mapInArrow(_span_rows(buckets, length), _ROW)
    kinds = base.select(*names).schema
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields] + ["n_bytes long", "n_removed long", "spans array<struct<start: long, end: long>>", "text string" if as_text else "kept binary"])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(out))
    return by_doc.cogroup(meet(spans, "bucket").groupBy("bucket")).applyInArrow(_cut_rows(names, arrow), out)


def numbered(base: DataFrame, id_column: str) -> DataFrame:
    """Row numbers in order of id, then text, where ids are null or not unique: a range sort, counts of
    each partition, and numbers within it."""
    ordered = checkpoint(base.orderBy(F.col(id_column).asc_nulls_first(), F.col("_bytes")).withColumn("_n", F.monotonically_increasing_id()))
    part = F.shiftright("_n", 33)
    counts = ordered.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    # one row for each partition
    before = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))
    return ordered.withColumn("_p", part).join(before, "_p").withColumn("_rid", F.col("_before") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_n", "_before")
