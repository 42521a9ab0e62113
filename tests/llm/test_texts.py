"""Repetition rule, SimHash, suffix dedup, decontamination and packing against brute force."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import decontaminate, packing, repetition, simhash, suffix_dedup
from tidemill.llm.suffix_array import common_prefixes, suffix_array

SCHEMA = "doc_id long, text string, lang string, id long, fp string, _bytes string, piece int, component long, text_ string"


def frame(spark, rows, parts=3):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 7, "x", "y", 3, 4, "z") for i, t in rows], SCHEMA).repartition(parts)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(80)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    rows = []
    for i in range(n):
        text = " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 3, 9, 40, 200])))
        if i % 5 == 0:
            text += " " + passage + " " + " ".join(r.choice(vocabulary) for _ in range(5))
        if i % 7 == 0 and rows:
            text = rows[r.randrange(len(rows))][1]
        if i % 11 == 0:
            text = "x" * 130 + "\n" + "same line here\nsame line here\n" * 4
        rows.append((i, text))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "word " * 9000)]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- suffix arrays ------------------------------------------------------------------------------------


@given(st.lists(st.integers(0, 4), max_size=60))
@settings(max_examples=60, deadline=None)
def test_suffix_array(ids):
    a = np.array(ids, np.int64)
    order, ranks = suffix_array(a, keep_ranks=True)
    assert order.tolist() == sorted(range(len(ids)), key=lambda i: ids[i:])
    common = common_prefixes(order, ranks, 1)
    for k in range(1, len(ids)):
        x, y = ids[order[k - 1] :], ids[order[k] :]
        n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert common[k] == n


# --- repetition ---------------------------------------------------------------------------------------


def covered(words, k):
    at: dict[tuple, list[int]] = {}
    for i in range(len(words) - k + 1):
        at.setdefault(tuple(words[i : i + k]), []).append(i)
    return len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + k)})


def test_repetition(spark):
    rows = corpus() + [(3, "again " * 30), (None, "no id at all")]
    got = repetition.repetition_rule(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for i, t in rows:
        words, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        r5 = covered(words, 5)
        by_text[(i, len(words))] = (sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), r5, len(words) < 10 or 100 * r5 > 20 * len(words), covered(words, 10))
    for r in got:
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.covered_words) == by_text[(r.doc_id, r.n_words)]
        assert not (r.kept and r.base_failed)
        assert (r.longest_repeat >= 10) == (r.covered_words > 0)
    by_length = {len(WORD.findall(t or "")): longest_repeat(WORD.findall(t or "")) for _, t in rows}
    for r in got:
        own = by_length[r.n_words]
        assert r.longest_repeat == (own if own >= 10 else 0) or sum(len(WORD.findall(t or "")) == r.n_words for _, t in rows) > 1


def longest_repeat(words):
    """Words of the longest string of words that begins at two places, by doubling a guess and narrowing it."""
    low, high = 0, len(words)
    while low < high:
        k = (low + high + 1) // 2
        at = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if k < 2000 else [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        low, high = (k, high) if len(set(at)) < len(at) else (low, k - 1)
    return low


def test_repetition_empty(spark):
    assert repetition.repetition_rule(frame(spark, [])).count() == 0


# --- SimHash ------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark):
    rows = corpus(3, 40) + [(2, "a twin of an id"), (None, "nobody"), (50, "Ärger UND Überfluß")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(t) for _, t in rows]
    assert sorted(((r.id is None, r.id or 0), r.fp % (1 << 64)) for r in got) == sorted(((i is None, i or 0), f) for (i, _), f in zip(rows, fps))
    root = brute_components(fps)
    ids = {}
    for (i, _), k in zip(rows, root):
        if i is not None:
            ids[k] = min(ids.get(k, i), i)
    expected = {(i, f): ids.get(k) for (i, _), f, k in zip(rows, fps, root)}
    assert {(r.id, r.fp % (1 << 64)): r.component for r in got} == expected
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_anchor_links_miss_nothing(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base.tolist():
        for n in (1, 2, 3, 4):
            g = f
            for b in r.choice(64, n, replace=False).tolist():
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    links = simhash.near_links(spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long"))
    stars = {x.node % (1 << 64): x.root for x in simhash.components(links).collect()}
    root = brute_components(fps)
    for i in range(len(fps)):
        for j in range(i):
            assert (root[i] == root[j]) == (fps[i] in stars and fps[j] in stars and stars[fps[i]] == stars[fps[j]]), (i, j)


@pytest.mark.parametrize("block", [2, 2048])
def test_many_near_copies_of_one_fingerprint(spark, monkeypatch, block):
    """Every member of a ball around one fingerprint; small blocks take the way for large groups."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    fp = np.array([0] + [1 << b for b in range(64)] + [(1 << a) | (1 << 40) for a in range(20)], np.uint64)
    home = np.ones(len(fp), bool)
    i, j = simhash._links(fp, home, 0, 3)
    assert len(i) == len(fp) - 1  # a spanning tree, not all pairs


def test_chain_components(spark):
    n = 300
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(chain).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


# --- suffix dedup -------------------------------------------------------------------------------------


def brute_cut(rows, length):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("length,bucket", [(100, 2 << 20), (40, 4000), (20, 3000)])
def test_suffix_dedup(spark, monkeypatch, length, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(suffix_dedup, "TASK_BYTES", bucket * 2)
    rows = corpus(9, 70)
    got = suffix_dedup.remove_repeats(frame(spark, rows), length=length, keep=("lang", "component")).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got} == {(i, n, g, tuple(s), k) for i, n, g, s, k in brute_cut(rows, length)}
    assert {(r.lang, r.component) for r in got} == {("en", 4)}


def test_suffix_dedup_of_long_strings_and_ids_in_steps(spark):
    r = random.Random(2)
    long = "".join(r.choice("abcdef ") for _ in range(1500))
    rows = [(64 * i, "".join(r.choice("uvwxyz") for _ in range(r.randint(0, 400))) + long[r.randint(0, 400) :] + "tail" * (i % 3)) for i in range(40)]
    got = suffix_dedup.remove_repeats(frame(spark, rows), length=700).collect()
    assert {(r.doc_id, r.n_removed, bytes(r.kept)) for r in got} == {(i, g, k) for i, _, g, _, k in brute_cut(rows, 700)}
    assert len({64 * i % suffix_dedup._prime(64) for i in range(67)}) == 67
    for wrong in ({"length": 0}, {"length": 40_000}, {"keep": ("kept",)}):
        with pytest.raises(ValueError):
            suffix_dedup.remove_repeats(frame(spark, rows).withColumnRenamed("text_", "kept"), **wrong)
    with pytest.raises(ValueError):
        simhash.near_duplicates(frame(spark, rows), radius=4).count()


def test_suffix_dedup_repeated_and_null_ids(spark):
    a, b = "abcdefghij" * 30 + "tail one", "0123456789" * 20 + "abcdefghij" * 15
    rows = [(5, b), (5, a), (5, a), (None, "first of all " + a), (4, None)]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    got = suffix_dedup.remove_repeats(frame(spark, rows), length=100).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2], x[3])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got), key=key) == sorted(((i, n, g, k) for i, n, g, _, k in brute_cut(ordered, 100)), key=key)
    assert suffix_dedup.remove_repeats(frame(spark, []), length=100).count() == 0


def test_a_hash_collision_is_found_and_mended(monkeypatch):
    """With a hash that knows only the first two letters, the byte check must still give the right order."""
    r = np.random.default_rng(2)
    data = r.integers(97, 100, 4000).astype(np.uint8)
    at, size = np.arange(0, 3900, 13), np.full(300, 60)
    group = np.arange(300) // 25
    monkeypatch.setattr(suffix_dedup, "_common", lambda s, pw, a, b, most: np.where((data[a] == data[b]), most, 0))
    order, common = suffix_dedup.sort_suffixes(data, at, size, group)
    text = [data[a : a + n].tobytes() for a, n in zip(at, size)]
    for g in range(12):
        own = order[g * 25 : g * 25 + 25]
        assert [text[i] for i in own] == sorted(text[g * 25 : g * 25 + 25])


@given(st.lists(st.text("ab", min_size=1, max_size=30), min_size=1, max_size=12))
@settings(max_examples=40, deadline=None)
def test_sort_suffixes(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    size = np.array([len(t) for t in texts])
    order, common = suffix_dedup.sort_suffixes(data, np.cumsum(size) - size, size, np.zeros(len(texts), np.int64))
    assert [texts[i] for i in order] == sorted(texts)


# --- decontamination ----------------------------------------------------------------------------------


TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("limit,together", [(16 << 20, 4), (200, 4), (200, 1)])
def test_decontamination(spark, monkeypatch, limit, together):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(decontaminate, "TOGETHER", together)
    rows = corpus(4, 50)
    r = random.Random(8)
    items = [(k, " ".join(terms(rows[r.randrange(50)][1])[s : s + 25])) for k, s in enumerate([0, 3, 8, 1, 0, 2, 5, 0])]
    items += [(90, "same line"), (91, None), (92, "..."), (90, "same line"), (None, "ab cd ef")]
    rows += [(70, "SAME-line, élan"), (None, "same line")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumnsRenamed({}).selectExpr("item_id", "text", "1 as id", "2 as words")
    windows: dict[tuple, set[str]] = {}
    for i, t in items:
        w = terms(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    got = decontaminate.find_contamination(frame(spark, rows), bench).collect()
    assert len(got) == len(rows)
    expected = set()
    for i, t in rows:
        w, hit, names = terms(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= found
        expected.add((i, len(w), len(hit), tuple(sorted(names)), bool(hit)))
    assert {(x.doc_id, x.n_words, x.n_hit, tuple(x["items"]), x.contaminated) for x in got} == expected
    longest, texts = {}, {}
    for i, t in items:
        texts.setdefault("" if i is None else str(i), []).append(terms(t))
    for i, t in rows:
        w, most = terms(t), 0
        for name, own in ((n, x) for n, all_ in texts.items() for x in all_):
            for a in range(len(own)):
                for k in range(len(w)) if min(10, len(own)) <= len(own) - a else ():
                    n = next((j for j in range(min(len(own) - a, len(w) - k)) if own[a + j] != w[k + j]), min(len(own) - a, len(w) - k))
                    most = max(most, n) if n >= min(10, len(own)) else most
        longest.setdefault(i, set()).add(most)
    assert all(x.longest_match in longest[x.doc_id] for x in got)
    of = {i: [terms(t) for j, t in rows if j == i] for i, _ in rows}
    for x in got:
        for m in x.matches:
            there = [own[m.item_start : m.item_start + m.end - m.start] for own in texts[m["item"]]]
            assert any(w[m.start : m.end] in there for w in of[x.doc_id])
        assert x.longest_match == max((m.end - m.start for m in x.matches), default=0)
    named = frame(spark, rows).withColumnRenamed("fp", "_tidemill_text")
    left = decontaminate.remove_contaminated(named, bench)
    assert left.columns == named.columns and {x._tidemill_text for x in left.collect()} == {"x"}
    assert {x.doc_id for x in left.collect()} == {i for i, _, _, _, bad in expected if not bad}


def test_the_longest_match_is_over_all_places_of_a_window():
    ten = [b"w%d" % k for k in range(10)]
    s = decontaminate.prepare([(1, b" ".join([*ten, b"x"]).decode()), (2, b" ".join([b"a", *ten, b"y", b"z", b"q"]).decode()), (3, b" ".join([*ten, b"y"]).decode())], 10)
    text, start, size, window, longest, there = decontaminate._matches([[*ten, b"y", b"z", b"q", b"r"]], s)
    first = int(np.flatnonzero(start == 0)[0])
    assert longest[first] == 13 and s.names[s.owner[there[first]]] == "2" and s.offset[there[first]] == 1
    assert [m for _, m in decontaminate._maximal(text, start, longest, there, s)] == [{"start": 0, "end": 13, "item": "2", "item_start": 1}]


def test_a_shard_looks_at_windows_of_its_own_words_only():
    items = [(k, " ".join(f"v{k}x{j}" for j in range(30))) for k in range(2000)]
    s = decontaminate.prepare([*items, (5000, "alone"), (5001, "v7x1 alone")], 10)
    assert len(s.size) == 2000 * 21 + 2
    numbers = lambda *w: np.array([s.numbers.get(x, 0) for x in w], np.int64)
    assert len(s.possible(numbers(*[b"v7x%d" % j for j in range(30)]))) == 21
    assert not len(s.possible(numbers(b"v7x1", b"v7x2", b"?", b"v7x4")))
    assert s.size[s.possible(numbers(b"alone", b"v7x1"))].tolist() == [1]
    assert sorted(s.size[s.possible(numbers(b"v7x1", b"alone"))].tolist()) == [1, 2]


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.find_contamination(frame(spark, [(1, "a b")]), none).collect()] == [False]
    assert decontaminate.find_contamination(frame(spark, []), none).count() == 0


# --- packing ------------------------------------------------------------------------------------------


@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
@settings(max_examples=80, deadline=None)
def test_plan(counts):
    filled: dict[int, list[tuple[int, int]]] = {}
    placed: dict[int, set[int]] = {}
    for length, rank, n, first, offset in packing.plan(counts, 32):
        for i in range(n):
            filled.setdefault(first + i, []).append((offset, length))
            assert rank + i not in placed.setdefault(length, set())
            placed[length].add(rank + i)
    assert {k: set(range(n)) for k, n in counts.items()} == placed
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 32
    assert len(filled) <= 11 / 9 * max(1, -(-sum(k * n for k, n in counts.items()) // 32)) * 1.5 + 1


def test_packing(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary(packing.TOKENIZER))
    rows = corpus(6, 30) + [(1, "twice"), (None, "no id"), (60, "<|endoftext|> 🦊 \r\n\t  x")]
    got = packing.pack_documents(frame(spark, rows), capacity=64).collect()
    texts = [np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in rows]
    expected = []
    for (i, _), ids in zip(rows, texts):
        first = len(ids) % 64 or 64
        for k, s in enumerate([0, *range(first, len(ids), 64)]):
            part = ids[s : first if k == 0 else s + 64]
            expected.append((i, k, s, len(part), zlib.crc32(part.tobytes())))
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=key) == sorted(expected, key=key)
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= 1.05 * -(-sum(map(len, texts)) // 64) + 1
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_op4_ids_are_those_of_the_tokenizer_file(spark, tmp_path):
    """By the file alone, nothing set on it: the string of an added token is that token; no white space is too long."""
    import corpus_pipeline
    from tidemill.llm import queries
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary(packing.TOKENIZER))
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>" * 1500), (3, "x" + " " * 1_200_000 + "y"), (4, "<|endoftext> |>"), (5, None), (None, "plain")]
    frame(spark, rows, 1).write.parquet(str(tmp_path / "documents.parquet"))
    expected = []
    for i, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        for k, s in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[s : first if k == 0 else s + 1024]
            expected.append((i or 0, k, s, len(part), zlib.crc32(part.tobytes())))
    for got in (queries.op4_histogram_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, frame(spark, rows), "")):
        assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got.collect()) == sorted(expected)


def test_word_ids_are_those_of_the_whole_text():
    from tokenizers import Tokenizer

    at = packing.vocabulary(packing.TOKENIZER)
    plain, encode = Tokenizer.from_file(at), packing.encoder(at)
    r = random.Random(11)
    pool = ["a", "B", " ", " ", "word", " the", "\n ", " \n", "'s", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u3000", "9", "½", "é", "漢", "🦊", "\u0558", "\ud7ff", "_", "!", "\u200d", "ǆ"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["x" * 5000 + " y" * 3, " " * 3000 + "z", "." * 3000, "1" * 2_000_00, "\n" * 200_000, "".join(map(chr, range(0x20, 0x3000)))]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("ranked", [1 << 10, 3])
def test_places_of_a_length_in_groups(spark, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    parts = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate([5] * 40 + [3] * 11 + [8] * 2)], "id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(parts, 8).collect()
    by: dict[int, list] = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert len(got) == 53 and len(by) == 42 and sorted(sorted(v) for v in by.values()) == sorted([[(0, 8)]] * 2 + [[(0, 5), (5, 3)]] * 11 + [[(0, 5)]] * 29)
