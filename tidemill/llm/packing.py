"""Best-fit packing planned on a histogram of lengths.

Documents become pieces of at most `capacity` tokens. The plan only needs how many pieces there are of
each length, at most `capacity` numbers: best-fit decreasing over counts puts all pieces of a length
into the fullest sequences that still take them, a whole range of sequences at a time. The plan is a
short table of ranges (length, ranks, first sequence, offset); pieces take their planned slots by a
join of their rank within their length. Ranks come from counts of (length, bucket of documents) and
ranks within those, so that a length that a third of all pieces have is not in one task.

Token ids are those of a tokenizer file (library `tokenizers`, no special tokens added). A byte-level BPE
model merges only within the words that its fixed pattern cuts a text into, so each worker asks the
file's model once for each different word, and keeps the ids of up to CACHED stretches from a space to the
next; a text is then its stretches' ids behind one another. (No word goes over a space that a character
follows; texts with a space before white space or at their end are cut by the pattern itself.) Texts that hold the string of an added token, or a character that is not
assigned (the pattern's classes may differ there), and files of another kind are encoded whole.

Defined results
* null text counts as empty: its only token is the end mark, one piece of length 1.
* repeated rows and ids are packed each; null ids stay null; other columns are ignored.
* the string of an added token in a text is that token, as the tokenizer file alone has it.
* a very long text, run of white space or word is encoded like any other, whole.
* an empty table gives an empty result. Pieces of equal length are ranked by id, then by piece.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import checkpoint, chunks, small_batches

CAPACITY = 1024
#: Pieces of a length that are ranked together, about: RANKED, or where there would be more than GROUPS groups in all,
#: as many as give so many. The driver gets a number for each group.
RANKED, GROUPS = 1 << 10, 1 << 16
END_TOKEN = 2
#: Stretches whose ids a worker keeps, and characters of one that is kept at most.
CACHED, KEPT_LENGTH = 1 << 19, 64
#: A public vocabulary file.
TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: the words of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write a byte: as itself where it is printable, else as a letter from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


@lru_cache(maxsize=2)
def encoder(tokenizer: str) -> Callable[[str], bytes]:
    """text -> its ids as little-endian unsigned 32-bit numbers."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)

    def plain(text: str) -> bytes:
        return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    with open(tokenizer, encoding="utf-8") as f:
        file = json.load(f)
    if file["model"]["type"] != "BPE" or file["normalizer"] or file["pre_tokenizer"] != _BYTE_LEVEL or file["model"].get("dropout"):
        return plain
    added = [t["content"] for t in file["added_tokens"]]
    words, model, letters = regex.compile(PATTERN).findall, whole.model, _byte_letters()
    blank, number = re.compile(r" (?:\s|\Z)").search, attrgetter("id")
    pack_ids = [struct.Struct(f"<{n}I").pack for n in range(KEPT_LENGTH + 1)]

    class Known(dict):
        """Ids by text; a missing one is found, and kept while there is room. After many that found none, all go."""

        def __init__(self, find: Callable[[str], bytes]):
            self.find, self.turned_away = find, 0

        def __missing__(self, part: str) -> bytes:
            ids = self.find(part)
            if len(part) <= KEPT_LENGTH:
                if len(self) < CACHED:
                    self[part] = ids
                elif (turned := self.turned_away + 1) > 4 * CACHED:
                    self.clear()
                    self.turned_away = 0
                else:
                    self.turned_away = turned
            return ids

    def one(word: str) -> bytes:
        if len(word) > KEPT_LENGTH:
            return plain(word)
        # of printable ASCII only the space is written as another letter
        plainly = word.isascii() and word.isprintable()
        ids = list(map(number, model.tokenize(word.replace(" ", letters[32]) if plainly else word.encode().decode("latin-1").translate(letters))))
        return pack_ids[len(ids)](*ids) if len(ids) <= KEPT_LENGTH else np.array(ids, "<u4").tobytes()

    single = Known(one)

    def cut(part: str) -> bytes:
        return b"".join(map(single.__getitem__, words(part)))

    def stretch(part: str) -> bytes:
        if part.isalpha():
            return one(" " + part)
        # its first word mostly comes as a stretch too
        first, *rest = words(" " + part)
        return (known[first[1:]] if first[1:].isalpha() else single[first]) + b"".join(map(single.__getitem__, rest))

    #: stretches that a space is before; one of letters is one word, as long as it is kept only here
    known, assigned = Known(stretch), set()

    def odd(text: str) -> bool:
        """Whether the text has a character that is not assigned, as far as this Python knows."""
        if new := set(text) - assigned:
            if any(unicodedata.category(c) == "Cn" for c in new):
                return True
            assigned.update(new)
        return False

    def run(text: str) -> bytes:
        if any(x in text for x in added) or not text.isascii() and odd(text):
            return plain(text)
        if blank(text):
            return cut(text)
        first, *rest = text.split(" ")
        return cut(first) + b"".join(map(known.__getitem__, rest))

    return run


def _piece_rows(tokenizer: str | None, capacity: int, end: int):
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, mark = encoder(tokenizer or vocabulary(TOKENIZER)), end.to_bytes(4, "little")
        for batch in chunks(batches, "text"):
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + mark
                n = len(ids) // 4
                first = n % capacity or capacity
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    stop = start + capacity if k else first
                    for column, x in zip(out, (doc, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]))):
                        column.append(x)
            yield pa.record_batch([pa.array(x, pa.int32() if n == "piece" else pa.int64()) for n, x in zip(names, out)], names=names)

    return run


def pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end: int = END_TOKEN, tokenizer: str | None = None) -> DataFrame:
    """id, piece, start, length, ids_crc32 of each piece; only a document's first piece may be short."""
    base = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    return base.mapInArrow(_piece_rows(tokenizer, capacity, end), "id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on counts: (length, first rank, ranks, first sequence, offset).

    Piece first_rank + i of that length goes to sequence first_sequence + i. Open sequences are kept as
    ranges by the space they have left; there are at most `capacity` different spaces."""
    room: dict[int, list[tuple[int, int]]] = {}  # space left -> ranges (first sequence, sequences)
    out, next_ = [], 0
    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        spaces = [s for s in room if s >= length]
        heapify(spaces)
        while todo:
            while spaces and not room.get(spaces[0]):
                heappop(spaces)
            if spaces:
                space = spaces[0]
                first, n = room[space].pop()
            else:
                # new sequences, each to be filled with as many of this length as fit
                space = capacity
                first, n = next_, -(-todo // (capacity // length))
                next_ += n
            use = min(n, todo)
            out.append((length, rank, use, first, capacity - space))
            rank, todo = rank + use, todo - use
            if n > use:
                room.setdefault(space, []).append((first + use, n - use))
            if left := space - length:
                room.setdefault(left, []).append((first, use))
                if left >= length:
                    heappush(spaces, left)
            if n > use and space not in spaces:
                heappush(spaces, space)
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces(length, id, piece, ...)."""
    spark = parts.sparkSession
    parts = checkpoint(parts)
    # at most `capacity` rows of two numbers; a length with many pieces is ranked in as many groups as it needs
    sizes = parts.groupBy("length").agg(F.count("*").alias("n"))
    together = max(RANKED, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // GROUPS))
    sizes = sizes.select(F.col("length").alias("_l"), F.ceil(F.col("n") / together).alias("_groups"))
    parts = parts.join(F.broadcast(checkpoint(sizes)), F.col("length") == F.col("_l")).withColumn("_bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("_groups")).cast("int")).drop("_l", "_groups")
    # a row for each length, and at most GROUPS more
    tally = [tuple(r) for r in parts.groupBy("length", "_bucket").agg(F.count("*").alias("n")).collect()]
    counts, before = Counter(), []
    for length, bucket, n in sorted(tally):
        before.append((length, bucket, counts[length]))
        counts[length] += n
    starts = spark.createDataFrame(before, "length long, _bucket int, _before long")
    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("_length", "_rank", "_ranks", "_first", "offset")])
    slots = spark.createDataFrame(plan(counts, capacity), kind)
    within = Window.partitionBy("length", "_bucket").orderBy("id", "piece", "start", "ids_crc32")
    ranked = parts.withColumn("_r", F.row_number().over(within) - 1).join(F.broadcast(starts), ["length", "_bucket"]).withColumn("_r", F.col("_r") + F.col("_before"))
    # the plan has a few thousand ranges whatever the input: its size follows the number of lengths
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("_length")) & (F.col("_r") >= F.col("_rank")) & (F.col("_r") < F.col("_rank") + F.col("_ranks")))
    return placed.withColumn("sequence_id", F.col("_first") + F.col("_r") - F.col("_rank")).drop("_bucket", "_before", "_r", "_length", "_rank", "_ranks", "_first")


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end: int = END_TOKEN, tokenizer: str | None = None) -> DataFrame:
    packed = pack(pieces(docs, id_column, text_column, capacity, end, tokenizer), capacity)
    return packed.select(F.col("id").alias(id_column), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
