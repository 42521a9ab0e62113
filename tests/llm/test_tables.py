"""Filter audit, vector codes and language identification against brute force, odd rows and held-out rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import filter_audit, language_id, vector_codes

# --- filter audit -------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in rows}:
        own = [r for r in rows if r[0] == part]
        removed = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in own if f in r[1]]
                out[part, order, k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                removed[f] += len(gone)
        for (p, order, k), v in out.items():
            if p == part:
                v.append(removed[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit_rows(seed, n=70):
    r = random.Random(seed)
    texts = ["", None, "ALL CAPITALS HERE", "few words | and a mark", " \t\n\x0b", "same words same words " * 60, " ".join(f"w{k}" for k in range(250)), "é" * 30 + "A", "word " * 100 + " ".join(map(str, range(100)))]
    docs = [(i, r.choice(texts) if r.random() < 0.7 else " ".join(r.choice(["a", "B", "c#"]) for _ in range(r.randint(0, 260))), r.choice(["en", "de", None, ""])) for i in range(n)]
    docs += [(3, docs[3][1], "fr"), docs[5], docs[5], (None, None, "en"), (None, "few words | and a mark", "en"), (None, None, None)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, n, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_against_brute_force(spark, seed):
    docs, labels = audit_rows(seed)
    frame = spark.createDataFrame([(*d, "x", "y", 1, 2) for d in docs], "doc_id long, text string, lang string, part string, digest string, mask int, good int").repartition(5)
    got = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == ["part", "filter_order", "step", *names]
    assert {(x.part, x.filter_order, x.step): tuple(x[c] for c in names) for x in got.collect()} == brute_audit(docs, labels)


def test_audit_of_nothing_and_of_hot_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"), F.lit("en").alias("lang"))
    row = filter_audit.audit(hot, labels).where("filter_order = 'EABCD' and step = 1").first()
    assert (row.kept, row.removed, row.redundant, row.unique_fails) == (1, 2999, 0, 0)
    long = spark.createDataFrame([(1, "word " * 300_000, "en")], "doc_id long, text string, lang string")
    assert filter_audit.audit(long, labels).where("filter_order = 'BACDE' and step = 1").first().removed == 1


def test_audit_with_other_filters(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b b", "x"), (3, "a", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels, filters={"S": lambda text, words: F.size(words) < 2})
    assert {(r.filter_order, r.step, r.kept, r.removed, r.redundant, r.good_lost, r.shapley) for r in got.collect()} == {("SE", 1, 1, 2, 0, 1, 3), ("SE", 2, 1, 0, 1, 0, 1), ("ES", 1, 2, 1, 0, 0, 1), ("ES", 2, 1, 1, 1, 1, 3)}


# --- vector codes -------------------------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds, scale=4096):
    kept = [(i, v, y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    width = len(kept[0][1]) // parts
    ints = [[math.floor(scale * x) for x in v] for _, v, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[cut[k][p] for k in range(min(entries, len(cut)))] for p in range(parts)]
    nearest = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        codes = [[nearest(v[p], p)[1] for p in range(parts)] for v in cut]
        books = [[[sum(c[p][d] for c, k in zip(cut, codes) if k[p] == j) // n for d in range(width)] if (n := sum(k[p] == j for k in codes)) else books[p][j] for j in range(len(books[p]))] for p in range(parts)]
    done = [[nearest(v[p], p) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in x) for x in done]
    by_label = Counter()
    for (_, _, y), e in zip(kept, errors):
        by_label[y] += e
    sha = hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in x), e, by_label[y]) for (i, _, y), x, e in zip(kept, done, errors)], sha


SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, code string, error string, more_0 int"


def vectors(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", 1) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("n,entries,few", [(300, 16, 10_000), (300, 16, 0), (40, 32, 10_000), (5, 16, 10_000)])
def test_codes_against_brute_force(spark, monkeypatch, n, entries, few):
    monkeypatch.setattr(vector_codes, "FEW_LABELS", few)
    monkeypatch.setattr(vector_codes, "BLOCK_NUMBERS", 64)
    r = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(0, 1, 16).round(2 if i % 3 else 0)], int(r.integers(0, 4)) if i % 5 else None) for i in r.permutation(n)]
    rows += [rows[0], rows[0], (None, rows[1][1], 2), (7, None, 1), (8, [], 1), (9, [None] * 16, 1), (10, [float("nan")] * 16, 1), (11, [float("inf")] + [0.0] * 15, 1), (12, [1.0] * 8, 1)]
    rows += [(1000 + k, rows[2][1], 3) for k in range(100)]
    expected, sha = brute_codes(rows, 4, entries, 6)
    got = vector_codes.compress(vectors(spark, rows), parts=4, entries=entries)
    assert Counter((x.vec_id, x.code, x.error, x.label_error) for x in got.collect()) == Counter(expected)
    assert {x.codebooks_sha256 for x in got.collect()} == {sha}


def test_codes_of_odd_tables(spark):
    assert vector_codes.compress(vectors(spark, [])).count() == 0
    assert vector_codes.compress(vectors(spark, [(1, None, 1), (2, [float("nan")] * 8, 1)])).count() == 0
    one = vector_codes.compress(vectors(spark, [(1, [0.5] * 8, None)])).first()
    assert (one.code, one.error, one.label_error) == ("00" * 8, 0, 0)
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(vectors(spark, [(1, [0.5] * 9, 1)]))
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.compress(vectors(spark, [(1, [1e30] * 8, 1)])).collect()


def test_codes_read_back(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(0, 0.3, 32).tolist(), 1) for i in range(400)]
    frame = vector_codes._finite(vectors(spark, rows), "vec_id", "embedding")
    books = vector_codes.train(frame, 8, 64, 6, 4096)
    back = vector_codes.decode(vector_codes.encode(frame, books), books)
    truth = {i: np.float32(v).astype(float) for i, v, _ in rows}
    for x in back.collect():
        off = np.floor(truth[x.id] * 4096) - np.array(x.vector) * 4096
        assert int(round(float(off @ off))) == x.error
    assert np.mean([np.sum((truth[x.id] - x.vector) ** 2) / np.sum(truth[x.id] ** 2) for x in back.collect()]) < 0.45


# --- language identification --------------------------------------------------------------------------


def brute_ngrams(text):
    """Within words of letters and bytes of other scripts, ends of words marked."""
    out = Counter()
    for word in re.findall(rb"[a-z\x80-\xff]+", text.lower().encode()):
        marked = b" " + word + b" "
        for n in language_id.LENGTHS:
            for k in range(len(marked) - n + 1):
                part = marked[k : k + n]
                out[part] += part not in (b" ",)
    return +out


@pytest.mark.parametrize("block", [7, 64, 1 << 18])
def test_ngrams(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    texts = ["Ab c1D", None, "", "ÉÀ e", "x", "  ", "a-b-c", "日本"]
    found = [Counter() for _ in texts]
    for owner, bucket in language_id.ngrams(pa.array(texts)):
        for o, b in zip(owner.tolist(), bucket.tolist()):
            found[o][b] += 1
    mask = (1 << 64) - 1
    of = lambda g: ((int.from_bytes(g, "big") + (len(g) << 56)) * 0x9E3779B97F4A7C15 & mask) >> (64 - language_id.BITS)
    for t, got in zip(texts, found):
        expected = Counter()
        for g, n in brute_ngrams(t or "").items():
            expected[of(g)] += n
        # neighbouring words share a space, and a pair of words has none between them
        assert got == expected


def test_machines_reach_the_least_loss():
    r = np.random.default_rng(2)
    x = np.vstack([r.normal(0.5, 1, (60, 6)), r.normal(-0.5, 1, (30, 6))]).astype(np.float32)
    y = np.repeat([1.0, -1.0], [60, 30])
    w, b = language_id.support_vectors(x, y, penalty=5.0)
    c = 10 / np.where(y > 0, 60, 30)
    short = np.maximum(0, 1 - y * (x @ w + b))
    assert np.abs(w - (c * y * short) @ x).max() < 1e-3 and abs(1e-3 * b - (c * y * short).sum()) < 1e-3


def invented(seed, n):
    """Four languages of two families: the family by its letters, the language by how words end."""
    r = random.Random(seed)
    kinds = {"en": ("bcdf", "ing"), "de": ("bcdf", "ung"), "fr": ("mnpr", "eux"), "es-MX": ("mnpr", "ión")}
    out = []
    for i in range(n):
        lang = sorted(kinds)[i % 4]
        letters, end = kinds[lang]
        words = ["".join(r.choice(letters) + r.choice("aeiou") for _ in range(r.randint(1, 3))) + (end if r.random() < 0.4 else "") for _ in range(r.randint(8, 60))]
        out.append((i, " ".join(words), lang))
    return out


def test_languages_by_family_and_pair(spark):
    rows = invented(1, 400) + [(900, None, "en"), (901, "babaing", None), (902, "12 34", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es-MX", "fr"]}
    assert model.machines == [("family", "germanic"), ("de", "en"), ("es-MX", "fr")]
    held = invented(2, 200)
    more = [(800, None, "x"), (801, "", "x"), (802, "12 !? 34", "x"), (803, "babaing " * 200_000, "x"), (None, "babaing cadaing", "x"), (None, "babaing cadaing", "x")]
    frame = spark.createDataFrame([(*r, "t", 1, "u") for r in held + more], "doc_id long, text string, lang string, id string, score int, lettered string").repartition(3)
    got = language_id.predict(frame, model).collect()
    assert len(got) == len(held) + len(more) and all(0 <= r.score <= 1 for r in got)
    of = {r.doc_id: r.lang_pred for r in got}
    assert np.mean([of[i] == lang for i, _, lang in held]) > 0.98
    assert [(of[i], {r.score for r in got if r.doc_id == i}) for i in (800, 801, 802)] == [("und", {0.0})] * 3
    assert of[803] == "en" and sum(r.doc_id is None and r.lang_pred == "en" for r in got) == 2


def test_many_families_and_votes(spark):
    r = random.Random(4)
    langs = {"en": "ing", "de": "ung", "nl": "ijk", "fr": "eux", "tlh": "qaH", "fi": "inen"}
    rows = [(i, " ".join("".join(r.choice("abdeklmnorstu") for _ in range(4)) + langs[k] for _ in range(20)), k) for i, k in enumerate([*langs] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.where("doc_id < 240"))
    assert sorted(model.families) == ["germanic", "romance", "tlh", "uralic"] and len(model.machines) == 4 + 3
    got = language_id.predict(docs.where("doc_id >= 240"), model).join(docs, "doc_id").collect()
    assert np.mean([x.lang_pred == x.lang for x in got]) > 0.98


def test_little_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", "en"), (2, "def", "en"), (3, None, None)], "doc_id long, text string, lang string")
    of = lambda m: {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, m).collect()}
    assert of(language_id.train(docs)) == {1: ("en", 1.0), 2: ("en", 1.0), 3: ("und", 0.0)}
    nothing = language_id.train(docs.where("lang is null"))
    assert nothing is None and {x for x, _ in of(nothing).values()} == {"und"}
    assert language_id.predict(docs.limit(0), language_id.train(docs)).count() == 0
    assert language_id.train(docs.limit(0)) is None


def test_the_sample_is_bounded_and_even(spark):
    rows = spark.createDataFrame(invented(5, 2000), "doc_id long, text string, lang string")
    seen = []
    plain = language_id.support_vectors

    def spy(x, y, *a):
        seen.append(len(y))
        return plain(x, y, *a)

    language_id.support_vectors = spy
    try:
        language_id.train(rows, sample=200)
    finally:
        language_id.support_vectors = plain
    assert seen == [200, 100, 100]


def test_language_held_out_accuracy(spark):
    from tidemill.llm.queries import op13_language_families

    at = "/root/testdata/sf0.01"
    got = op13_language_families(spark, at).where("held_out").join(spark.read.parquet(f"{at}/documents.parquet").where("lang is not null"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97


def test_a_word_before_a_mark_is_asked_of_the_model_once(monkeypatch):
    import types

    import numpy as np
    import tokenizers

    from tidemill.llm import packing

    path = packing.vocabulary(packing.TOKENIZER)
    real, asked = tokenizers.Tokenizer.from_file(path), []
    model = types.SimpleNamespace(tokenize=lambda w: asked.append(w) or real.model.tokenize(w))
    monkeypatch.setattr(tokenizers, "Tokenizer", types.SimpleNamespace(from_file=lambda p: types.SimpleNamespace(model=model, encode=real.encode)))
    packing.encoder.cache_clear()
    try:
        for text in ("so word word, word; (word) word.\nword\tword don't naïve, naïve 12, 12", "é, é ab- ab", "x \x7f, y\x01, y"):
            assert np.frombuffer(packing.encoder(path)(text), "<u4").tolist() == real.encode(text, add_special_tokens=False).ids
    finally:
        packing.encoder.cache_clear()
    assert asked.count("Ġword") == 1 and asked.count("Ġab") == 1
