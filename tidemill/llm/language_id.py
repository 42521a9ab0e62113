"""Language identification in two levels: first the family, then the language within it.

A text is the shares of its letter n-grams (1 to 5 bytes, within words, ends of words marked). Families are told
apart by linear support vector machines, one for each family against the rest; within a family, one linear
machine for each pair of its languages votes, so that related languages are judged by what sets just those
two apart. A text's margins are sums over its n-grams: texts of any length are read whole, in blocks.

Training uses at most SAMPLE labelled rows, as many of each language (chosen by hashes of id and text), and the FEATURES n-grams whose shares differ most between languages, so what reaches the driver
is bounded; every row is predicted. Families are a parameter; a language that no family lists is its own.

Defined results
* a text that is null or has no letter is `und` with score 0, as is every text if nothing was learned.
* with a single language learned, every text with a letter is that language, with score 1.
* rows without a text or language are not learned from; an empty language name is a language like others.
* equal margins go to the name that is first in order. Repeated rows, null ids: each row is predicted by its
  text alone; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import checkpoint, chunks, release, small_batches, text_bytes

#: Labelled rows that are learned from at most, over all languages.
SAMPLE = 4_000
#: n-grams that are features at most.
FEATURES = 2_048
#: Hashed n-grams are told apart by so many bits.
BITS = 16
#: Lengths of n-grams, in bytes of UTF-8.
LENGTHS = (1, 2, 3, 4, 5)
#: Text bytes handled at a time, and places of n-grams within them.
SLICE_BYTES, BLOCK = 1 << 20, 1 << 18
#: Texts whose dense features a task holds at a time.
DENSE_ROWS = 64

# ISO 639-1 codes by family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "co", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd", "kw"),
    "uralic": ("et", "fi", "hu", "se"),
    "turkic": ("az", "ba", "kk", "ky", "tk", "tr", "tt", "ug", "uz"),
    "semitic": ("am", "ar", "he", "mt", "ti"),
    "iranian": ("fa", "ku", "os", "ps", "tg"),
    "indo-aryan": ("as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "sd", "si", "ur"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "sino-tibetan": ("bo", "dz", "my", "zh"),
    "tai": ("lo", "th"),
    "austroasiatic": ("km", "vi"),
    "austronesian": ("id", "jv", "mg", "mi", "ms", "sm", "su", "tl"),
    "bantu": ("rw", "sn", "st", "sw", "xh", "zu"),
}


def family_of(language: str, families: dict[str, tuple[str, ...]] = FAMILIES) -> str:
    """The family that lists the language (its code without region or script), or the language itself."""
    code = language.replace("_", "-").partition("-")[0].lower()
    return next((f for f, codes in families.items() if code in codes), language)


def _letter_bytes() -> np.ndarray:
    """ASCII letters and all bytes of other scripts stay; the rest ends words."""
    return np.array([b if b >= 0x80 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


_LETTERS = _letter_bytes()


def ngrams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text number and hash of each n-gram of a slice's texts, in blocks.

    Every text stands between two spaces; only an n-gram's first and last byte may be one, so none crosses words or texts."""
    data, offsets = text_bytes(pc.utf8_lower(column.cast(pa.string()).fill_null("")))
    count = len(column)
    line = np.full(len(data) + count + 1, 32, np.uint8)
    for k in range(count):
        line[offsets[k] + k + 1 : offsets[k + 1] + k + 1] = _LETTERS[data[offsets[k] : offsets[k + 1]]]
    owners = np.append(np.repeat(np.arange(count, dtype=np.int32), np.diff(offsets) + 1), np.int32(count))
    for begin in range(0, len(line), BLOCK):
        own = line[begin : begin + BLOCK + max(LENGTHS) - 1]
        some = min(BLOCK, len(line) - begin)
        owner = owners[begin : begin + some]
        blank = own == 32
        key, whole = own[:some].astype(np.uint64), np.ones(some, bool)
        for n in LENGTHS:
            if n > 1:
                some = min(some, len(own) - n + 1)
                key = (key[:some] << np.uint64(8)) | own[n - 1 : n - 1 + some]
                whole = whole[:some]
                if n > 2:
                    whole = whole & ~blank[n - 2 : n - 2 + some]
            # two spaces are nothing, a short word between them is itself
            taken = whole & ~blank[:some] if n == 1 else whole & ~(blank[:some] & blank[1 : some + 1]) if n == 2 else whole
            mixed = (key[taken] + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)
            yield owner[:some][taken], (mixed >> np.uint64(64 - BITS)).view(np.int64)


def _totals(column: pa.Array, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    total = np.zeros(len(column))
    for owner, _ in found:
        total += np.bincount(owner, minlength=len(column))
    return np.maximum(total, 1)


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a slice: sums of the shares of each n-gram over the texts of each language."""
    for batch in chunks(batches, "text", SLICE_BYTES):
        found = list(ngrams(batch.column("text")))
        total = _totals(batch.column("text"), found)
        langs = batch.column("lang").dictionary_encode()
        of = langs.indices.to_numpy()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            sums = np.zeros(1 << BITS)
            for owner, bucket in found:
                mine = of[owner] == k
                sums += np.bincount(bucket[mine], 1 / total[owner[mine]], 1 << BITS)
            at = np.flatnonzero(sums)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(sums[at])], names=["lang", "bucket", "share"])


def _dense(place: np.ndarray, size: int):
    """The shares of the chosen n-grams in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", SLICE_BYTES):
            for start in range(0, part.num_rows, DENSE_ROWS):
                batch = part.slice(start, DENSE_ROWS)
                rows = np.zeros(batch.num_rows * size)
                total = np.zeros(batch.num_rows)
                for owner, bucket in ngrams(batch.column("text")):
                    total += np.bincount(owner, minlength=batch.num_rows)
                    at = place[bucket]
                    rows += np.bincount(owner[at >= 0] * size + at[at >= 0], minlength=len(rows))
                rows = (rows.reshape(-1, size) / np.maximum(total, 1)[:, None]).astype(np.float32)
                yield pa.record_batch([batch.column("lang"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["lang", "x"])

    return run


def support_vectors(x: np.ndarray, y: np.ndarray, penalty: float = 300.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """A linear machine: weights and bias that minimise |w|^2 / 2 + penalty * mean over classes of squared hinge losses.

    Newton's method on the rows within the margin; the steps are solved by conjugate gradients."""
    count = np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    c = 2 * penalty / count  # both classes weigh the same
    ridge = np.append(np.ones(x.shape[1]), 1e-3)
    w = np.zeros(x.shape[1] + 1)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        short = np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))
        return float((ridge * w * w).sum() / 2 + (c * short * short).sum() / 2), short

    def across(rows: np.ndarray, u: np.ndarray) -> np.ndarray:
        return np.append(u @ rows, u.sum())

    now, short = loss(w)
    for _ in range(rounds):
        inside = short > 0
        rows, weigh = x[inside], c[inside]
        slope = ridge * w - across(rows, weigh * y[inside] * short[inside])
        size = slope @ slope
        if size <= 1e-12 * max(1.0, now):
            break
        step, left = np.zeros_like(w), -slope
        ahead, before = left.copy(), size
        for _ in range(200):
            bent = ridge * ahead + across(rows, weigh * (rows @ ahead[:-1] + ahead[-1]))
            far = before / (ahead @ bent)
            step += far * ahead
            left -= far * bent
            after = left @ left
            if after <= 1e-6 * size:
                break
            ahead = left + after / before * ahead
            before = after
        length = 1.0
        while length > 1e-6:
            then, shorter = loss(w + length * step)
            if then <= now + 1e-4 * length * (slope @ step):
                break
            length /= 2
        else:
            break
        w, done = w + length * step, now - then <= 1e-9 * now
        now, short = then, shorter
        if done:
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Languages by family, and for each machine what it is for: ("family", name) or (language, language).

    Of two families, only the first has a machine."""

    families: dict[str, list[str]]
    machines: list[tuple[str, str]]
    weights: np.ndarray  # [machine, hashed n-gram]
    biases: np.ndarray

    def margins(self, column: pa.Array) -> np.ndarray:
        """[text, machine]"""
        out, total = np.zeros((len(column), len(self.machines))), np.zeros(len(column))
        for owner, bucket in ngrams(column):
            if not len(owner):
                continue
            # the texts of a block follow one another
            first = np.append(0, np.flatnonzero(owner[1:] != owner[:-1]) + 1)
            texts = owner[first]
            total[texts] += np.diff(np.append(first, len(owner)))
            for k, w in enumerate(self.weights):
                out[texts, k] += np.add.reduceat(w[bucket], first)
        return out / np.maximum(total, 1)[:, None] + self.biases

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each text."""
        margin = self.margins(column)
        at = {m: k for k, m in enumerate(self.machines)}
        names = sorted(self.families)
        if len(names) > 1:
            by = np.stack([margin[:, at["family", f]] if ("family", f) in at else -margin[:, at["family", names[0]]] for f in names], axis=1)
            family, sure = by.argmax(axis=1), _chance(by)
        else:
            family, sure = np.zeros(len(column), int), np.ones(len(column))
        found, score = np.empty(len(column), object), np.zeros(len(column))
        for k, name in enumerate(names):
            mine = np.flatnonzero(family == k)
            languages = self.families[name]
            votes = np.zeros((len(mine), len(languages)))
            sums = np.zeros((len(mine), len(languages)))
            for (i, a), (j, b) in itertools.combinations(enumerate(languages), 2):
                m = margin[mine, at[a, b]]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                sums[:, i] += m
                sums[:, j] -= m
            # most votes; equal votes go by the sum of margins
            best = np.lexsort((np.arange(len(languages))[::-1] + 0 * sums, sums, votes), axis=1)[:, -1]
            found[mine] = np.array(languages, object)[best]
            share = _chance(sums / max(1, len(languages) - 1)) if len(languages) > 1 else np.ones(len(mine))
            score[mine] = sure[mine] * share
        return found, score


def _chance(margins: np.ndarray) -> np.ndarray:
    """The largest share of exp(2 * margin)."""
    e = np.exp(2 * np.clip(margins - margins.max(axis=1, keepdims=True), -30, 0))
    return 1 / e.sum(axis=1)


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = SAMPLE, families: dict[str, tuple[str, ...]] = FAMILIES) -> Model | None:
    """Learn from the rows of docs that have a text and a language; None if there are none."""
    rows = docs.where(F.col(text_column).isNotNull() & F.col(lang_column).isNotNull())
    rows = rows.select(F.col(id_column).alias("id"), F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text")).where(F.col("text").rlike(r"\p{L}"))
    languages = rows.groupBy("lang").count().orderBy("lang").collect()
    if not languages:
        return None
    names = [r["lang"] for r in languages]
    want = max(1, sample // len(names))
    # first by a share of all hashes that leaves a third more than are wanted, so that no task ever sorts a whole language
    share = F.create_map(*(F.lit(x) for r in languages for x in (r["lang"], min(1.0, (4 / 3 * want + 100) / r["count"]))))
    rows = rows.withColumn("hash", F.xxhash64("id", "text")).where(F.pmod("hash", F.lit(1 << 32)) < F.element_at(share, F.col("lang")) * float(1 << 32))
    chosen = rows.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("at") <= want)
    small_batches(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = checkpoint(chosen.select("lang", "text").repartition(parts))
    shares = checkpoint(chosen.mapInArrow(_shares, "lang string, bucket long, share double").groupBy("lang", "bucket").agg(F.sum("share").alias("share")))
    sizes = chosen.groupBy("lang").agg(F.count("*").alias("n"))
    means = shares.join(F.broadcast(sizes), "lang").groupBy("bucket").agg(F.max(F.col("share") / F.col("n")).alias("most"), F.min(F.col("share") / F.col("n")).alias("least"), F.count("*").alias("k"), F.avg(F.col("share") / F.col("n")).alias("mean"))
    apart = (F.col("most") - F.when(F.col("k") < len(names), 0.0).otherwise(F.col("least"))) / F.sqrt("mean")
    # ends in FEATURES rows of two numbers
    top = means.orderBy(F.desc(apart), "bucket").limit(FEATURES).select("bucket", "mean").collect()
    buckets = np.array([r["bucket"] for r in top], np.int64)
    scale = 1 / np.sqrt(np.array([r["mean"] for r in top]))
    place = np.full(1 << BITS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))
    # at most `sample` rows of FEATURES numbers
    got = chosen.mapInArrow(_dense(place, len(buckets)), "lang string, x binary").toArrow()
    own = np.array(got.column("lang").to_pylist(), object)
    x = np.empty((got.num_rows, len(buckets)), np.float32)
    for k, row in enumerate(got.column("x")):
        x[k] = np.frombuffer(row.as_buffer(), np.float32)
    del got
    release()
    x *= (scale / np.sqrt(max(1, len(buckets))) * 8).astype(np.float32)
    scale = scale / np.sqrt(max(1, len(buckets))) * 8
    grouped: dict[str, list[str]] = {}
    for name in names:
        grouped.setdefault(family_of(name, families), []).append(name)
    # of two families, one machine tells both
    told = sorted(grouped)[: 1 if len(grouped) == 2 else None] if len(grouped) > 1 else []
    tasks = [(("family", f), np.isin(own, grouped[f]), np.ones(len(own), bool)) for f in told]
    for langs in grouped.values():
        tasks += [((a, b), own == a, (own == a) | (own == b)) for a, b in itertools.combinations(langs, 2)]
    weights, biases = np.zeros((len(tasks), 1 << BITS)), np.zeros(len(tasks))
    for k, (_, yes, among) in enumerate(tasks):
        w, biases[k] = support_vectors(x[among], np.where(yes[among], 1.0, -1.0))
        weights[k, buckets] = w * scale
    return Model(grouped, [t[0] for t in tasks], weights, biases)


def predict(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, lang_pred, score of every row."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    rows = rows.withColumn("lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if model is None:
        return rows.select(F.col("id").alias(id_column), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each machine and hashed n-gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SLICE_BYTES):
            found, score = shared.value.predict(batch.column("text"))
            yes = batch.column("lettered").to_numpy(zero_copy_only=False)
            yield pa.record_batch([batch.column("id"), pa.array(np.where(yes, found, "und"), pa.string()), pa.array(np.where(yes, score, 0.0))], names=["id", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_column)
