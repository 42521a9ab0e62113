"""Toxicity: a linear classifier with counterfactual regularisation.

Features of a text are its words and the first letters of its words; a feature counts in how many
different words it occurs. Those that tell the classes apart (a two-proportion z-score) are kept and a
logistic regression is fitted on them. Words that say whom or what a text is about are swapped in the
labelled texts for others of their kind and for a neutral word, and squared changes of the score under such swaps
are a penalty of the fit: a weight that only says what a text mentions is driven to zero, so neutral
mentions of a group are not scored as attacks on it.

Which words those are is a list of identity terms (a parameter), and learned from the labels in whatever
language they are: words that stand beside words of the toxic class in a share of its texts, but occur in other texts
too and do not tell the classes apart themselves, or only by such company: of the texts in which such a word is
the only one of the toxic class, at most twice the usual share is toxic. Function words stand beside everything, too; they are
told by their company: the function words of a language occur in the same texts, namely in nearly all of it, while what a text is about
shares no such word's texts. They are no terms. A learned term is swapped for the one that it
shares most texts with, which is one of its language and use. All terms are features of the fit.

The fit uses at most SAMPLE labelled rows (those with the smallest hashes of their ids), so what reaches
the driver is bounded; every row of the documents is scored.

Defined results
* null and empty texts have no features; their score is the model's bias alone.
* labels that are null, or whose id is null or has no document, are not used; an id labelled twice is
  toxic if one label says so; of documents with one id, the one with the least text is used in the fit. Without both classes
  the score is the smoothed share of the toxic class (0.25 without labels: nothing is
  called toxic on no evidence).
* every row is scored, repeated ones too; other columns are ignored; an empty table gives none.
* very long texts are scored whole, on all their words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_map, checkpoint, chunks, free_name, small_batches

#: Labelled rows used in the fit at most.
SAMPLE = 16_000
#: Text bytes handled at a time: a slice's words and their features are Python objects, many times its size.
SLICE_BYTES = 512 << 10
#: Words whose features a task keeps.
KEPT_WORDS = 1 << 17
#: Numbers of letters of a word's beginning that are features besides the word itself.
BEGINNINGS = (4, 5, 6, 7, 8)
#: A feature needs so many labelled texts and so large a z-score; a word that is plainly of one class needs the greater one.
LEAST_TEXTS, LEAST_Z, PLAIN_Z = 6, 3.0, 5.0
#: A learned term stands within BESIDE words of a toxic one in this share of the toxic texts.
BESIDE, LEAST_SHARE = 2, 0.05
#: A learned term is no function word: none that shares COMPANY of its texts with one of the COMMON most frequent features,
#: if that is a word of a share of MANY of the texts.
COMPANY, MANY, COMMON = 0.5, 0.04, 400

# Identity terms by kind; terms of a kind can stand for one another.
IDENTITIES = (
    ("men", "women", "males", "females", "boys", "girls"),
    ("man", "woman", "male", "female", "boy", "girl"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "african", "european", "american", "arab", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "transgender", "queer"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("hombres", "mujeres", "niños", "niñas"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos", "gitanos"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
    ("hommes", "femmes", "garçons", "filles"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "tsiganes"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("männer", "frauen", "jungen", "mädchen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer", "roma"),
    ("einwanderer", "flüchtlinge", "ausländer", "bürger"),
)
NEUTRAL = "people"


def _letters() -> bytes:
    """ASCII letters, digits and all bytes of other scripts stay; the rest ends words."""
    return bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


_LETTERS = _letters()


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_LETTERS).split()


def features(word: bytes) -> list[int]:
    """Hashes of the word and of its beginnings."""
    h = xxhash.xxh64_intdigest
    text = word.decode(errors="replace")
    out = [h(b"=" + word)]
    out += [h(b"^" + text[:n].encode()) for n in BEGINNINGS if len(text) >= n]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def kinds_map(kinds: tuple[tuple[str, ...], ...]) -> dict[bytes, bytes]:
    """Each term and the next of its kind."""
    return {a.encode(): b.encode() for kind in kinds for a, b in zip(kind, kind[1:] + kind[:1])}


def swaps(own: set[bytes], next_: dict[bytes, bytes]) -> list[set[bytes]]:
    """The text's words with its terms swapped: for the next of their kind, and for a neutral word."""
    found = {w for w in next_ if w in own}
    return [(own - found) | {next_[w] for w in found}, (own - found) | {NEUTRAL.encode()}] if found else []


@dataclass
class Model:
    bias: float
    weights: dict[int, float] = field(default_factory=dict)
    #: terms that were swapped, and pairs of texts and counterfactuals that the fit saw
    terms: dict[bytes, bytes] = field(default_factory=dict)
    pairs: int = 0

    def learn(self, vocabulary: set[bytes], known: dict[bytes, list[int]]) -> None:
        """Add the features that the model has of the words to `known`."""
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in vocabulary:
            if w not in known:
                known[w] = [f for f in features(w) if f in self.weights]

    def logit(self, own: set[bytes], known: dict[bytes, list[int]]) -> float:
        count = Counter(f for w in own for f in known[w])
        return self.bias + sum(self.weights[f] * math.log1p(n) for f, n in count.items())

    def scores(self, texts: list[str | None], known: dict[bytes, list[int]]) -> np.ndarray:
        own = [set(words(t or "")) for t in texts]
        self.learn(set().union(*own), known)
        return logit_to_score(np.array([self.logit(w, known) for w in own]))


@dataclass
class Sparse:
    """Rows of (column, value), as parallel arrays."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    rows: int
    columns: int

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * v[self.column], self.rows)

    def back(self, u: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * u[self.row], self.columns)


#: Numbers of features in each row, and all rows' features and values behind one another.
Lists = tuple[np.ndarray, np.ndarray, np.ndarray]


def lists(column: pa.Array, values: pa.Array) -> Lists:
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(), values.flatten().to_numpy()


def sparse(rows: Lists, columns: np.ndarray) -> Sparse:
    """columns: all features, sorted; one more column is for the bias."""
    sizes, f, v = rows
    return Sparse(np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(columns, f), v, len(sizes), len(columns) + 1)


def fit(y: np.ndarray, rows: Lists, changes: Lists, penalty: float = 4.0, ridge: float = 0.5, rounds: int = 60) -> Model:
    """Newton steps, solved by conjugate gradients, on log loss + ridge * |w|^2 / 2 + penalty * sum of squared logit changes.

    y, rows: labels and features of the texts; changes: what each swap changes of them."""
    columns = np.union1d(rows[1], changes[1])
    if not len(y) or y.min() == y.max() or not len(columns):
        return _share(int(y.sum()), len(y))
    x, d = sparse(rows, columns), sparse(changes, columns)
    own = np.full(len(columns) + 1, ridge)
    own[-1] = 1e-6
    # the changes touch few columns (the terms'): their products are a small dense matrix
    at = np.unique(d.column)
    bend = _products(d, at) * 2 * penalty

    def logits(w: np.ndarray) -> np.ndarray:
        return x.times(w) + w[-1]

    def back(u: np.ndarray) -> np.ndarray:
        out = x.back(u)
        out[-1] += u.sum()
        return out

    def bent(w: np.ndarray) -> np.ndarray:
        out = own * w
        out[at] += bend @ w[at]
        return out

    w = np.zeros(len(columns) + 1)
    squares = np.bincount(x.column, x.value**2, x.columns)
    squares[-1] = len(y)
    begun = 0.0
    for _ in range(rounds):
        p = logit_to_score(logits(w))
        spread = np.maximum(p * (1 - p), 1e-4)
        residual = -(back(p - y) + bent(w))
        size_now = math.sqrt(residual @ residual)
        begun = begun or size_now
        if size_now <= 1e-9 * begun:
            break
        # preconditioned by the diagonal, and by the whole matrix among the terms' columns
        lean = own + squares * spread.mean()
        inner = np.linalg.inv(bend + np.diag(lean[at]))

        def ahead_of(r: np.ndarray) -> np.ndarray:
            out = r / lean  # noqa: B023
            out[at] = inner @ r[at]  # noqa: B023
            return out

        step, ahead = np.zeros_like(w), ahead_of(residual)
        direction, goal = ahead.copy(), min(0.1, size_now / begun) * size_now
        for _ in range(10 * len(w)):
            curved = back(spread * logits(direction)) + bent(direction)
            size = (residual @ ahead) / (direction @ curved)
            step += size * direction
            before = residual @ ahead
            residual = residual - size * curved
            if math.sqrt(residual @ residual) <= goal:
                break
            ahead = ahead_of(residual)
            direction = ahead + (residual @ ahead) / before * direction
        w += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return Model(float(w[-1]), {f: v for f, v in zip(columns.tolist(), w.tolist()) if v}, pairs=d.rows)


def _products(d: Sparse, at: np.ndarray) -> np.ndarray:
    """Sums of products of the columns `at` over all rows, some thousand rows at a time."""
    out = np.zeros((len(at), len(at)))
    place = np.searchsorted(at, d.column)
    edges = np.searchsorted(d.row, np.arange(0, d.rows + 4096, 4096))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        dense = np.zeros((4096, len(at)))
        dense[d.row[a:b] - 4096 * k, place[a:b]] = d.value[a:b]
        out += dense.T @ dense
    return out


def _share(bad: int, all_: int) -> Model:
    share = (bad + 0.5) / (all_ + 2)
    return Model(math.log(share / (1 - share)))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts of a slice each feature occurs."""
    for batch in chunks(batches, "text", SLICE_BYTES):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        cache: dict[bytes, list[int]] = {}
        for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            got: set[int] = set()
            for w in set(words(text or "")):
                if w not in cache:
                    cache[w] = features(w)
                got.update(cache[w])
            counts[int(label)].update(got)
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["f", "bad", "good"])


def _beside(strong: set[int]):
    """Of a slice: in how many toxic texts a word stands beside another one with a feature in `strong`; in how many
    toxic and other texts a word is the only such one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tells: dict[bytes, bool] = {}
        for batch in chunks(batches, "text", SLICE_BYTES):
            if len(tells) > KEPT_WORDS:
                tells.clear()
            near, alone = Counter(), (Counter(), Counter())
            for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                line = words(text or "")
                own = set(line)
                tells.update({w: features(w)[0] in strong for w in own if w not in tells})
                toxic = {w for w in own if tells[w]}
                if len(toxic) == 1:
                    alone[int(label)].update(toxic)
                if label:
                    at = [k for k, w in enumerate(line) if w in toxic]
                    near.update({w for k in at for w in line[max(0, k - BESIDE) : k + BESIDE + 1] if w != line[k]})
            found = sorted(near.keys() | alone[0].keys() | alone[1].keys())
            columns = [[w.decode(errors="replace") for w in found], [features(w)[0] for w in found], *([c[w] for w in found] for c in (near, alone[1], alone[0]))]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, (pa.string(), *[pa.int64()] * 4))], names=["word", "f", "near", "bad_alone", "good_alone"])

    return run


def _together(keys: list[int]):
    """In how many texts of a slice two of the words occur; keys are the words' hashes."""
    place = {w: k for k, w in enumerate(keys)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in chunks(batches, "text", SLICE_BYTES):
            if len(known) > KEPT_WORDS:
                known.clear()
            counts = np.zeros((len(keys), len(keys)), np.int64)
            for text in batch.column("text").to_pylist():
                own = set(words(text or ""))
                known.update({w: place.get(features(w)[0], -1) for w in own if w not in known})
                at = np.array(sorted({known[w] for w in own} - {-1}), np.int64)
                counts[at[:, None], at] += 1
            a, b = np.nonzero(counts)
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(counts[a, b])], names=["a", "b", "n"])

    return run


def _cooccurrence(texts: DataFrame, keys: list[int]) -> np.ndarray:
    """In how many texts two words occur; the square of the words is collected."""
    counts = np.zeros((len(keys), len(keys)))
    both = texts.mapInArrow(_together(keys), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    for r in both.collect():
        counts[r["a"], r["b"]] = r["n"]
    return counts


def everyday(counts: np.ndarray, terms: int, all_: int) -> np.ndarray:
    """Which of the first `terms` words are function words of some language: words that share COMPANY of their texts with
    another word of many texts, which also has no more others than that."""
    own = np.diag(counts)
    shared = counts / np.maximum(1, np.maximum(own[:, None], own[None, :]))
    np.fill_diagonal(shared, 0)
    often = own >= MANY * all_
    return (shared[:terms] * often).max(axis=1, initial=0) >= COMPANY


def _partners(counts: np.ndarray, terms: list[bytes]) -> dict[bytes, bytes]:
    """Each term and the other one that it shares most of its texts with (cosine)."""
    alone = np.sqrt(np.maximum(1, np.diag(counts)))
    near = counts / alone[:, None] / alone
    np.fill_diagonal(near, -1)
    return {w: terms[int(k)] for w, k in zip(terms, near.argmax(axis=1))}


def _counted(chosen: set[int], next_: dict[bytes, bytes]):
    """Values of the chosen features in each text, and what swaps change of them: lists of feature and value."""

    def values(own: set[bytes], cache: dict[bytes, list[int]]) -> dict[int, float]:
        for w in own:
            if w not in cache:
                cache[w] = [f for f in features(w) if f in chosen]
        return {f: math.log1p(n) for f, n in Counter(f for w in own for f in cache[w]).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, list[int]] = {}
        for batch in chunks(batches, "text", SLICE_BYTES):
            out: list[tuple[int, int, list[int], list[float]]] = []
            for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                if len(cache) > KEPT_WORDS:
                    cache.clear()
                got = set(words(text or ""))
                own = values(got, cache)
                out.append((label, 0, list(own), list(own.values())))
                for x in swaps(got, next_):
                    other = values(x, cache)
                    change = {f: own.get(f, 0.0) - other.get(f, 0.0) for f in sorted(own.keys() | other.keys())}
                    change = {f: v for f, v in change.items() if v}
                    out.append((label, 1, list(change), list(change.values())))
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()))
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["toxic", "swapped", "f", "v"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample: int = SAMPLE, penalty: float = 4.0, identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> Model:
    """Fit on at most `sample` labelled documents; labels has the ids that may be used."""
    spark = docs.sparkSession
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("_id")).agg(F.max(F.col(label_column).cast("int")).alias("toxic"))
    known = checkpoint(known.orderBy(F.xxhash64("_id"), "_id").limit(sample))
    # at most `sample` rows of two numbers
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), F.col("id") == F.col("_id"))
    small_batches(spark)
    texts = checkpoint(texts.groupBy("id").agg(F.min(F.struct("text", "toxic")).alias("m")).select("m.toxic", "m.text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return _share(bad, bad + good)
    tally = checkpoint(texts.mapInArrow(_tally, "f long, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") + F.col("good") >= LEAST_TEXTS))
    share = (F.col("bad") + F.col("good")) / F.lit(bad + good)
    z = (F.col("bad") / bad - F.col("good") / good) / F.sqrt(share * (1 - share) * F.lit(1 / bad + 1 / good))
    # no more features than the sample's texts have
    telling = {r["f"]: r["z"] for r in tally.where(share < 1).select("f", z.alias("z")).where(F.abs("z") >= LEAST_Z).collect()}
    next_ = kinds_map(identities)
    plain = {f: v for f, v in telling.items() if abs(v) >= PLAIN_Z}
    strong = {f for f, v in plain.items() if v > 0}
    sums = [F.sum(c).alias(c) for c in ("near", "bad_alone", "good_alone")]
    beside = texts.mapInArrow(_beside(strong), "word string, f long, near long, bad_alone long, good_alone long").groupBy("word", "f").agg(*sums)
    beside = beside.where(F.col("near") >= max(LEAST_TEXTS, math.ceil(LEAST_SHARE * bad)))
    # at most (2 * BESIDE * toxic words of a text) / LEAST_SHARE words
    near = beside.join(tally.where(F.col("good") >= LEAST_TEXTS).select("f"), "f").collect()
    usual = 2 * bad / (bad + good)
    company = lambda r: r["good_alone"] >= LEAST_TEXTS and r["bad_alone"] <= usual * (r["bad_alone"] + r["good_alone"])
    learned = sorted(r["word"].encode() for r in near if r["f"] not in plain or company(r))
    if learned:
        common = [r["f"] for r in tally.orderBy(F.desc(F.col("bad") + F.col("good")), "f").limit(COMMON).collect()]
        keys = [features(w)[0] for w in learned]
        counts = _cooccurrence(texts, [*keys, *(f for f in common if f not in set(keys))])
        stay = np.flatnonzero(~everyday(counts, len(learned), bad + good))
        learned = [learned[k] for k in stay]
        if len(learned) > 1:
            next_ = {**_partners(counts[np.ix_(stay, stay)], learned), **next_}
    chosen = telling.keys() | {features(w)[0] for w in next_}
    # of at most `sample` texts, and of two counterfactuals of each
    got = texts.mapInArrow(_counted(set(chosen), next_), "toxic int, swapped int, f array<long>, v array<double>").toArrow().combine_chunks()
    parts = [got.filter(pa.compute.equal(got.column("swapped"), k)).combine_chunks() for k in (0, 1)]
    rows, changes = (lists(*[pa.concat_arrays(p.column(c).chunks) if p.num_rows else pa.array([], p.column(c).type) for c in "fv"]) for p in parts)
    model = fit(parts[0].column("toxic").to_numpy().astype(float), rows, changes, penalty)
    model.terms = next_
    return model


def logit_to_score(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def keep_below(docs: DataFrame, model: Model, text_column: str = "text", limit: float = 0.5) -> DataFrame:
    """docs, all columns as they are, without the rows that score `limit` or more."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of the sample's features
    extra = free_name(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        for batch in chunks(batches, extra, SLICE_BYTES):
            low = m.scores(batch.column(extra).to_pylist(), known) < limit
            yield batch.drop_columns([extra]).filter(pa.array(low))

    return docs.withColumn(extra, F.col(text_column).cast("string")).mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of the sample's features
    known: dict[bytes, list[int]] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = shared.value.scores(batch.column(1).to_pylist(), known)
        return pa.record_batch([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    base = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return arrow_map(base, run, "id long, score double, predicted int", "text", SLICE_BYTES).withColumnRenamed("id", id_column)
