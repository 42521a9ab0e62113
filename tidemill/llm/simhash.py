"""SimHash near-duplicates by covering anchors.

Fingerprints: 64 bits; a bit is 1 if it is set in over half the hashes of a text's word shingles.

Search: two fingerprints within 3 bits differ by at most 1 in one of their 32-bit halves. In a half,
the low 31 bits are covered by the perfect Hamming code [31, 26]: each word lies within radius 1 of
just one code word, its home. If two words differ in one bit, the home of one lies within 1 + 1 = 2
bits of the other. So every fingerprint is replicated to all code words within the covering radius
plus the threshold (on average 15.5 of 2**26 in a half), and per anchor those at home there are
compared with all that were sent there, on all 64 bits. No pair within the threshold is missed.

Equal fingerprints count once throughout. In one anchor's task only the links of a spanning forest of
its members are emitted, so a large group of near copies gives as many links as members and not their
square. Components come from alternating large-star and small-star steps on links, each through a
checkpoint.

Defined results
* null text counts as empty; texts without words have fingerprint zero and link like any other.
* texts of fewer than `shingle` words have one shingle, all their words.
* a null id keeps its row: it has a fingerprint, and a component by its links; a component's id is the
  smallest id that is not null (null if there is none). Repeated rows and ids each give a row.
* other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_map, checkpoint, text_bytes

SEED = 42
RADIUS = 3
#: Members of one anchor up to which all pairs are compared at once; above it, members are compared
#: within groups that agree in one byte of the other half (3 differences leave one of 4 bytes equal).
BLOCK = 2048


def fingerprint(words: list[bytes], shingle: int = 3) -> int:
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([h(b" ".join(words), SEED)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(words) - shingle + 1
        hashes = np.fromiter([h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())], np.uint64, n)
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """id, fp (long, the 64 bits as a signed number)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        raw = data.tobytes().lower()  # bytes.lower() and bytes.split() know ASCII only
        fp = np.fromiter((fingerprint(raw[a:b].split(), shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())), np.uint64, batch.num_rows)
        return pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    base = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return arrow_map(base, run, "id long, fp long", "text")


# --- anchors ------------------------------------------------------------------------------------------

_MASK = np.uint64((1 << 31) - 1)


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Of 31-bit words: the exclusive or of the numbers 1..31 of the bits that are set; 0 in code words."""
    out = np.zeros(len(x), np.uint64)
    for k in range(5):
        parity = np.uint64(sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1))
        out |= (np.bitwise_count(x & parity).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
    return out


def _flip(x: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Flip the bit with this number from 1; number 0 flips nothing."""
    return np.where(number > 0, x ^ (np.uint64(1) << np.where(number > 0, number - np.uint64(1), np.uint64(0))), x)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the fingerprint, anchor, and whether it is at home there, for all anchors of each.

    From a word with syndrome s, the code words within 2 bits are the one reached by flipping bit s
    (or none if s is 0), and those reached by two bits i, j with i xor j = s."""
    index, anchor, home = [], [], []
    every = np.arange(len(fp))
    for half in (0, 1):
        word = (fp >> np.uint64(32 * half)) & _MASK
        s = _syndrome(word)
        tag = np.uint64(half << 31)
        index.append(every)
        anchor.append(_flip(word, s) | tag)
        home.append(np.ones(len(fp), bool))
        for i in range(1, 32):
            j = s ^ np.uint64(i)
            ok = (j > np.uint64(i)) & (s > 0)
            index.append(every[ok])
            anchor.append(_flip(_flip(word[ok], np.full(int(ok.sum()), i, np.uint64)), j[ok]) | tag)
            home.append(np.zeros(int(ok.sum()), bool))
    return np.concatenate(index), np.concatenate(anchor).astype(np.int64), np.concatenate(home)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1 << 14):
            fp = batch.column(0).slice(i, 1 << 14).to_numpy().view(np.uint64)
            index, anchor, home = anchors(fp)
            yield pa.record_batch([pa.array(anchor), pa.array(fp[index].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])


def _forest(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between places in fp, those of a spanning forest, as (member, root) places."""
    root = np.arange(len(fp))
    while True:
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if not (low != high).any():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    member = np.flatnonzero(root != np.arange(len(fp)))
    return member, root[member]


def _links(fp: np.ndarray, home: np.ndarray, half: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among one anchor's members: those at home there with all."""
    at, n = np.flatnonzero(home), len(fp)
    if not at.size or n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blocks = [(at, np.arange(n))]
    if len(at) * n > BLOCK * BLOCK:
        blocks = []
        for k in range(4):
            byte = ((fp >> np.uint64(32 * (1 - half) + 8 * k)) & np.uint64(255)).astype(np.int64)
            by = np.argsort(byte, kind="stable")
            for v in np.unique(byte[at]):
                every = by[np.searchsorted(byte[by], v) : np.searchsorted(byte[by], v, side="right")]
                blocks.append((every[home[every]], every))
    i, j = [], []
    for own, every in blocks:
        step = max(1, (1 << 20) // max(1, len(every)))
        for s in range(0, len(own), step):
            near = np.bitwise_count(fp[own[s : s + step], None] ^ fp[every][None, :]) <= radius
            x, y = np.nonzero(near)
            x, y = own[s : s + step][x], every[y]
            keep = x != y
            x, y = _forest(fp, x[keep], y[keep])
            i.append(x)
            j.append(y)
    return _forest(fp, np.concatenate(i), np.concatenate(j))


def _link_rows(radius: int):
    """Compares per anchor; rows arrive sorted by anchor, and an anchor may go on in the next batch."""

    def links(a: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        # anchors with two members only, the usual case, all at once
        new = np.concatenate(([True], a[1:] != a[:-1]))
        begin = np.flatnonzero(new)
        count = np.diff(np.concatenate((begin, [len(a)])))
        two = begin[count == 2]
        near = (home[two] | home[two + 1]) & (np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius)
        x, y = [fp[two[near]]], [fp[two[near] + 1]]
        for b, c in zip(begin[count > 2].tolist(), count[count > 2].tolist()):
            if home[b : b + c].any():
                i, j = _links(fp[b : b + c], home[b : b + c], int(a[b]) >> 31, radius)
                x.append(fp[b + i])
                y.append(fp[b + j])
        x, y = np.concatenate(x).view(np.int64), np.concatenate(y).view(np.int64)
        return pa.record_batch([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (batch.column("anchor").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("home").to_numpy(zero_copy_only=False))
            last = now[0][-1]
            cut = int(np.searchsorted(now[0], last))
            if cut or (held and held[0][0][-1] != last):
                whole = [np.concatenate(x) for x in zip(*held, tuple(x[:cut] for x in now))]
                if len(whole[0]):
                    yield links(*whole)
                held = []
            held.append(tuple(x[cut:] for x in now))
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    return run


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps(fp), all different -> links (u, v), u > v, that span each group of fingerprints."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius {radius}: the anchors cover 0 to {RADIUS}")
    rows = fps.select("fp").mapInArrow(_anchor_rows, "anchor long, fp long, home boolean")
    per_anchor = rows.repartition("anchor").sortWithinPartitions("anchor")
    return per_anchor.mapInArrow(_link_rows(radius), "u long, v long").distinct()


def components(links: DataFrame) -> DataFrame:
    """links(u, v) -> node, root: the least node that can be reached, for every node of a link.

    Large-star joins each node's greater neighbours to its least one, small-star its lesser ones; both
    keep components whole, and their alternation ends in stars after about log(n)**2 rounds."""
    edges = checkpoint(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        after = checkpoint(small)
        # the same links as before: stars
        tally = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))]
        if tuple(edges.agg(*tally).first()) == tuple(after.agg(*tally).first()):
            break
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: id, fp, component (the least id linked to it, itself included)."""
    marked = checkpoint(fingerprints(docs, id_column, text_column, shingle))
    classes = checkpoint(marked.groupBy("fp").agg(F.min("id").alias("first")))
    stars = components(near_links(classes, radius))
    rooted = classes.join(stars, classes["fp"] == stars["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(least, "root").select(F.col("fp").alias("f"), "component")
    return marked.join(named, marked["fp"] == named["f"]).select("id", "fp", "component")
