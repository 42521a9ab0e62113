"""Interaction audit of filters: what each filter removes alone, behind others, and in every order.

Each row gets a mask with a bit for each filter that it fails. The last filter fails repeats: rows whose
text a smaller id has too, anywhere in the table; a groupBy of the texts gives the smallest id of each.
Rows are counted by part and mask, 2^n cells a part, and every order of the filters is worked out from those
cells alone: the rows that reach a step are those whose mask has no bit of the filters before it.

Only DataFrame functions. Texts are grouped by their SHA-256, so 32 bytes a row are shuffled and not the
texts; equal texts are counted before the shuffle, so a large group of copies is one row of each task.

Defined results
* a null text counts as an empty one, a null part as the empty string.
* a row without an id is no repeat, and makes no other row one; rows with the same id and text do not
  make each other repeats; repeated rows count each.
* a row is good or toxic if one of its id's labels says so; labels without an id or document are not used.
* other columns are ignored; an empty table gives no parts and no rows.
* texts of any length are judged whole.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word, as everywhere in the operators on words.
WORD = r"[^\x20\x09-\x0D]+"
#: Values among which rows without an id are dealt, so that no task gets them all.
SALTS = 997


def _few_words(text: Column, words: Column) -> Column:
    return F.size(words) < 200


def _few_different_words(text: Column, words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long")


def _many_capitals(text: Column, words: Column) -> Column:
    return 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long")


def _symbols(text: Column, words: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


#: Filters of a text by itself, each true where it fails; the filter of repeats comes behind them.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {"A": _few_words, "B": _few_different_words, "C": _many_capitals, "D": _symbols}
REPEATS = "E"


def masks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang", filters: dict[str, Callable[[Column, Column], Column]] = FILTERS) -> DataFrame:
    """id, part, digest of the text, mask of the filters that the text fails by itself (bit 0 is the first filter)."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", "text", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"))
    failed = [F.when(f(F.col("text"), F.col("words")), 1 << k).otherwise(0) for k, f in enumerate(filters.values())]
    return rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(failed, F.lit(0)).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame, repeat_bit: int, id_column: str = "doc_id") -> DataFrame:
    """part, mask with the bit of repeats, and how many rows, good rows and toxic rows have it."""
    wanted = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("_id"), F.lit(0).alias("_salt"))
    wanted = wanted.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # no label has a salt but 0, so rows without an id spread over all tasks
    salt = F.when(F.col("id").isNull(), 1 + F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(0).cast("int")
    rows = masked.withColumn("salt", salt).join(wanted, (F.col("id") == F.col("_id")) & (F.col("salt") == F.col("_salt")), "left")
    rows = rows.select("id", "salt", "digest", "part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    kind = ["digest", "mask", "part", "good", "toxic"]
    same = rows.groupBy("id", "salt", *kind).agg(F.count("*").alias("n"))  # as the join dealt them: no shuffle
    nameless = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0))
    texts = same.groupBy(*kind).agg(F.sum("n").alias("n"), nameless.alias("nameless"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"))
    # a text has one row here for each part and label
    least = F.min("first.id").over(Window.partitionBy("digest"))
    texts = texts.withColumn("originals", F.col("nameless") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0))
    both = F.explode(F.array(F.struct(F.col("mask").alias("m"), F.col("originals").alias("rows")), F.struct((F.col("mask") + (1 << repeat_bit)).alias("m"), (F.col("n") - F.col("originals")).alias("rows"))))
    texts = texts.select("part", both.alias("x"), "good", "toxic").select("part", F.col("x.m").alias("mask"), F.col("x.rows").alias("rows"), "good", "toxic")
    count = lambda c: F.sum(F.when(F.col(c), F.col("rows")).otherwise(0)).alias(c)
    return texts.groupBy("part", "mask").agg(F.sum("rows").alias("rows"), count("good"), count("toxic"))


def orders(counted: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of the filters and step, worked out from a part's cells.

    kept, removed: rows after this step, and by it; redundant: rows that fail its filter and were gone before;
    unique_fails: rows that fail this filter and no other; good_lost, toxic_lost: such rows among the removed;
    shapley: rows that this filter removes, summed over all orders."""
    # at most 2^n cells a part
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "rows", "good", "toxic")).alias("cells"))
    names = ["".join(x) for x in itertools.permutations(letters)]
    n = len(letters)

    def total(cells: Column, wanted: Callable[[Column], Column], what: str = "rows") -> Column:
        return F.aggregate(F.filter(cells, lambda c: wanted(c["mask"])), F.lit(0).cast("long"), lambda a, c: a + c[what])

    def fair(own: int) -> Column:
        """Of n! orders, k! * (n - 1 - k)! have just the k filters of a set before this one."""
        sets = [s for s in range(1 << n) if not s & own]
        ways = [math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count()) for s in sets]
        return sum((w * total(F.col("cells"), lambda m, s=s: m.bitwiseAND(s | own) == own) for s, w in zip(sets, ways)), F.lit(0).cast("long"))

    at = parts.select("part", "cells", F.array(*(fair(1 << k) for k in range(n))).alias("fair"), F.explode(F.array(*map(F.lit, names))).alias("order"))
    at = at.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    place = [F.instr("order", x) for x in letters]
    bits = lambda hits: sum((F.when(hit, 1 << k).otherwise(0) for k, hit in enumerate(hits)), F.lit(0))
    at = at.withColumns({"bit": bits([p == F.col("step") for p in place]), "before": bits([p < F.col("step") for p in place])})
    cells_, bit, before = F.col("cells"), F.col("bit"), F.col("before")
    hit = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    removed = lambda m: hit(m) & ~gone(m)
    return at.select(
        "part",
        F.col("order").alias("filter_order"),
        "step",
        total(cells_, lambda m: ~gone(m) & ~hit(m)).alias("kept"),
        total(cells_, removed).alias("removed"),
        total(cells_, lambda m: hit(m) & gone(m)).alias("redundant"),
        total(cells_, lambda m: m == bit).alias("unique_fails"),
        total(cells_, removed, "good").alias("good_lost"),
        total(cells_, removed, "toxic").alias("toxic_lost"),
        F.get("fair", F.log2("bit").cast("int")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang", filters: dict[str, Callable[[Column, Column], Column]] = FILTERS) -> DataFrame:
    """The audit of `filters` and the filter of repeats behind them; labels has id, quality and toxic."""
    masked = masks(docs, id_column, text_column, part_column, filters)
    return orders(cells(masked, labels, len(filters), id_column), "".join(filters) + REPEATS)
