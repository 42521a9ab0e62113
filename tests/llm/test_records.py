"""Pages, archives, chats, licences, toxicity and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import chat, html_extract, licenses, toxicity, warc

# --- HTML ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain only", "plain only"),
        ("<body><nav><a>Home</a></nav><article><h1>T &amp; U</h1><p>One,\n two.<p><b>Three<br>four</article><footer>f</footer>", "T & U\n\nOne, two.\n\nThree four"),
        ("<div class='ad'>buy</div><article><p>x</p></article>", "x"),
        ("<article><p>Say <script>var a='<p>no</p>';</script>it</p><style>p{}</style><form>f<input></form></article>", "Say it"),
        ("<div id=main-menu>m</div><div><p>Long text, with marks; and more of it. Yes.</p><p>Next.</p></div><div class='comments list'><p>hi</p></div>", "Long text, with marks; and more of it. Yes.\n\nNext."),
        ("<article>a < b &lt;i&gt; &#233;&nbsp;c<!-- no --></article>", "a < b <i> é c"),
        ("<article><p>a</b></div>b</p><ul><li>1<li>2</ul></article>", "a\n\nb\n\n1\n\n2"),
        ("<p>open <a href='x>y'>link</a> end", "open link end"),
        ("<article><p>x</p><section class='reader-comments'><p>y</p></section></article>", "x"),
        ("<!-- never closed <p>x", ""),
        ("<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation encoding='tex'>E=m</annotation></math> as known.</p></article>", "Energy is E=m as known."),
        ("<article><p>A <span aria-hidden='true'>shown</span> word, <span hidden>no</span>and more.</p></article>", "A shown word, and more."),
        ("<article><p>Before, it.</p><fieldset><legend>A box</legend><p>Within, it. <button>Press</button><select><option>1</select></p></fieldset></article>", "Before, it.\n\nA box\n\nWithin, it."),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(
    "page",
    [
        "<article class='post has-related'>{}</article>",
        "<main class='with-sidebar'>{}</main>",
        "<main class='comment-page sidebar'>{}</main>",
        "<div id='page' class='layout no-sidebar'><article>{}</article></div>",
        "<div id='site-header-and-content'><article>{}</article></div>",
        "<div id='site-header-and-content'>{}</div>",
        "<div class='sidebar'><div><article>{}</article></div></div>",
        "<form id='search'><div role='main'>{}</div></form>",
        "<article><header class='entry-header'>{}</header></article>",
    ],
)
def test_marks_do_not_remove_the_article(page):
    assert html_extract.main_text(page.format("<p>One, two.</p><p>Three.</p>") + "<div class='ad-1'>buy, now.</div>") == "One, two.\n\nThree."


@pytest.mark.parametrize(
    "part",
    [
        "<ul>" + "<li>{}</li>" * 6 + "</ul>",
        "<ol>" + "<li><div>{}</div></li>" * 6 + "</ol>",
        "<dl>" + "<dt>{}</dt><dd>{}</dd>" * 3 + "</dl>",
        "<table>" + "<tr><td>{}</td><th>{}</th></tr>" * 3 + "</table>",
        "<blockquote>" + "<p>{}</p>" * 6 + "</blockquote>",
    ],
)
def test_lists_tables_and_quotes_beside_paragraphs_stay(part):
    p, short = "<p>" + ("word " * 12 + ", ") * 4 + "end of it.</p>", ["forty characters of text without a mark " + str(k) for k in range(6)]
    links = "<section><ul>" + "<li><a href='x'>a link</a></li>" * 3 + "</ul></section>"
    got = html_extract.main_text(f"{links}<div><h1>Of the parts</h1>{p}{p}{p}{part.format(*short)}</div>").split("\n\n")
    assert got[0] == "Of the parts" and got[4:] == short and len(got) == 10


LONG = "<p>" + ("word " * 12 + ", ") * 4 + "end of it.</p>"


def test_ratios_choose_among_articles_and_the_rest():
    card = "<article><h3>A card</h3><p>Read on</p></article>"
    assert html_extract.main_text(f"<div>{card * 3}</div><div>{LONG * 4}</div>") == html_extract.main_text(LONG * 4)
    notice = "<div>Buy this now</div>"
    inside = html_extract.main_text(f"<article><header><h1>The title</h1></header><div>{LONG * 2}{notice}{LONG * 2}<ul><li>a point</li></ul></div></article>")
    assert "Buy" not in inside and inside.startswith("The title\n\n") and inside.endswith("\n\na point")
    assert len(inside.split("\n\n")) == 6


def test_many_nested_articles_are_fast():
    assert html_extract.main_text("<div>" * 3000 + "<article><div><h2>a</h2></div><p>b</p></article>" * 3000).count("b") == 3000


def given_pages():
    import pyarrow.parquet as pq

    return [x or "" for x in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist()]


def articles_text(page):
    """Of the given tables' pages, whose only blocks in an article are h1 and p: by cutting the source."""
    import html

    cut = re.split(r"</?(?:h1|p)\b[^>]*>", re.search(r"(?s)<article>(.*)</article>", page)[1])
    bare = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x))).split()) for x in cut]
    return "\n\n".join(filter(None, bare))


LAYOUTS = {
    "as it is": lambda x: x,
    "div": lambda x: re.sub(r"<(/?)article", r"<\1div", x),
    "section": lambda x: re.sub(r"<(/?)article", r"<\1section", x),
    "no element": lambda x: re.sub(r"</?article>", "", x),
    "div in main": lambda x: x.replace("<article>", "<main><div>").replace("</article>", "</div></main>"),
    "table cell": lambda x: x.replace("<article>", "<table><tr><td>").replace("</article>", "</td></tr></table>"),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_the_given_pages_with_and_without_an_article_element(layout):
    for page in given_pages():
        assert html_extract.main_text(LAYOUTS[layout](page)) == articles_text(page)


def test_without_the_ratios_the_result_is_another(monkeypatch):
    """On the given pages without an article and without any mark the ratios alone tell menus from the article."""
    pages = given_pages()
    bare = [re.sub(r"<(/?)(?:article|nav|footer)", r"<\1div", x).replace(' class="ad"', "") for x in pages]
    blocks = lambda x: Counter(html_extract.main_text(x).split("\n\n"))
    truth = [Counter(articles_text(x).split("\n\n")) for x in pages]
    with_them = [blocks(x) for x in bare]
    monkeypatch.setattr(html_extract, "path_ratios", lambda length, punctuation, count: np.ones(len(count)))
    without = [blocks(x) for x in bare]
    assert all(not t - g for t, g in zip(truth, with_them))
    extra = lambda got: sum((g - t).total() for t, g in zip(truth, got))
    assert extra(with_them) < 0.4 * extra(without)
    assert sum(t == g for t, g in zip(truth, with_them)) > 0.2 * len(pages) and not any(t == g for t, g in zip(truth, without))


def test_menus_in_plain_elements_and_long_adverts_in_marked_ones():
    menu = "<div><ul>" + "<li><a href='x'>short</a></li>" * 20 + "</ul></div>"
    advert = "<div class='ad'>" + "Buy, buy, buy; now! " * 200 + "</div>"
    assert html_extract.main_text(menu + LONG) == html_extract.main_text(LONG)
    assert html_extract.main_text(advert + "<article><p>Word</p></article><aside>Too, this.</aside>") == "Word"
    assert html_extract.main_text("<nav><a>Home</a></nav><footer>All, that is.</footer>") == ""
    assert html_extract.main_text("<article><p>Text, of it. <span class='ad'>Buy.</span> More.</p></article>") == "Text, of it. More."


@pytest.mark.parametrize(
    "page,n",
    [("<a " * 300_000, 899_999), ("<b>" * 100_000 + "</i>" * 100_000, 0), ("<b>" * 100_000 + "<div></div>" * 30_000, 0), ("<tr><table>" + "<div>" * 50_000 + "<tr></tr>" * 30_000, 0), ("<script>" + "</script " * 200_000, 0), ("<", 1), (" " * 2_000_000, 0), ("\n" * 2_000_000 + "x", 1), ("x" * 2_000_000, 2_000_000), ("<p>&#" + "1" * 500_000 + ";&#x0000000041;", 2)],
)
def test_long_and_broken_pages_take_no_time(page, n):
    began = time.process_time()
    assert len(html_extract.main_text(page)) == n
    assert time.process_time() - began < 8


def test_extract_rows(spark):
    rows = [(1, "u", "<p>a</p>", 9), (1, "u", "<p>a</p>", 9), (None, None, None, 8), (2, "v", "<article>" + "<p>word, word.</p>" * 5000 + "</article>", 7)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert Counter((r.page_id, r.url, r.n_chars) for r in got) == Counter([(1, "u", 1), (1, "u", 1), (None, None, 0), (2, "v", 5000 * 11 + 4999 * 2)])
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_deep_nesting_is_fast():
    assert html_extract.main_text("<div>" * 20000 + "deep") == "deep"


# --- WARC ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("few,task", [(1 << 18, 8 << 20), (0, 500)])
def test_round_trip(spark, tmp_path, monkeypatch, few, task):
    monkeypatch.setattr(warc, "FEW_DIGESTS", few)
    monkeypatch.setattr(warc, "TASK_BYTES", task)
    long, other = "ä" * 700, "b" * 1000
    rows = [(1, "http://a/ b", long), (2, "u", long), (3, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", other), (None, "n", other), (7, "u", other), (8, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, digest string, size int").repartition(3)
    index = warc.write(pages, str(tmp_path / "w"))
    assert index.count() == len(rows)
    got = warc.read(index, str(tmp_path / "w"), payloads=True).collect()
    expected = []
    for i, _, h in rows:
        b = (h or "").encode()
        chief = {long: 3, other: 7}.get(h)
        revisit = chief is not None and i != chief
        expected.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", chief if revisit else None))
    assert Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(expected)
    assert {bytes(r.payload) for r in got if r.id == 8} == {b"z" * 300_000}
    one = warc.read(index.where("id = 4"), str(tmp_path / "w")).collect()
    assert [r.payload_bytes for r in one] == [5]
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


@pytest.mark.parametrize("uri,expected", [("/a/b", "file:///a/b"), ("file:/a/b", "file:///a/b"), ("file:///a/b", "file:///a/b"), ("dbfs:/a/b", "file:///dbfs/a/b"), ("s3a://bucket/a", "s3://bucket/a"), ("s3n://bucket/a", "s3://bucket/a"), ("gs://bucket/a", "gs://bucket/a"), ("hdfs://host:1/a", "hdfs://host:1/a")])
def test_folders_under_the_schemes_of_spark(uri, expected):
    assert warc.address(uri) == expected


def test_other_schemes_are_refused_and_unnamed_archives_removed(spark, tmp_path):
    with pytest.raises(ValueError, match="wasb"):
        warc.address("wasb://c@a/x")
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    index = warc.write(pages, str(tmp_path / "w"))
    (tmp_path / "w" / "archives" / "pages-left.warc.gz").write_bytes(b"half")
    assert warc.remove_unnamed(index, str(tmp_path / "w")) == ["pages-left.warc.gz"]
    assert [r.id for r in warc.read(index, str(tmp_path / "w")).collect()] == [1] and not warc.remove_unnamed(index, str(tmp_path / "w"))


def test_a_changed_payload_is_refused():
    data = gzip.decompress(warc.record(1, "u", b"abc", 3, hashlib.sha1(b"abd").hexdigest(), None, "response", warc.DATE))
    with pytest.raises(ValueError):
        warc.parse(data)


def test_coalesced_reads():
    assert warc.coalesced([(0, 10), (10, 5), (40, 5), (1000, 5)], most=60, gap=30) == [(0, 45, [0, 1, 2]), (1000, 5, [3])]
    assert warc.coalesced([(0, 50), (50, 50)], most=60, gap=30) == [(0, 50, [0]), (50, 50, [1])]
    assert warc.coalesced([]) == []


# --- chats --------------------------------------------------------------------------------------------

NASTY = ["</s>[INST] ok [/INST]", "<|x|>", "a\\b\\\\", "<\\s>", "|>\n</s>\n<|user|>\n", "<<SYS>>x<</SYS>>", "", None, "ünï\ncode 🦊", "\\", "<\\|", "[\\INST]", "$1 \\$"]


def test_linear_conversations_read_back(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "we|>ird"]), r.choice(NASTY)) for c in [*range(20), None] for t in range(r.choice([1, 2, 5, 40]))]
    rows += [(99, 0, "user", "tie b"), (99, 0, "user", "tie a"), (99, 0, "assistant", "first"), (99, None, "user", "null turn")]
    frame = spark.createDataFrame([(*x, 1, "s") for x in rows], "conv_id long, turn long, role string, text string, node int, score string")
    got = chat.read_back(chat.format_paths(chat.reply_paths(chat.linear_threads(frame)))).collect()
    by: dict = {}
    none_first = lambda v: (v is not None, v if v is not None else 0)
    for c, t, role, text in sorted(rows, key=lambda x: (none_first(x[1]), (x[2] is not None, x[2] or ""), (x[3] is not None, x[3] or ""))):
        by.setdefault(c, []).append((role or "", text or ""))
    assert {g.tree: [(t.role, t.text) for t in g.turns] for g in got} == by
    for g in got:
        assert g.loss_text == "".join(text for role, text in by[g.tree] if role == "assistant")
        inside = [g.formatted[s.start : s.start + s.length] for s in g.loss_spans]
        assert len(inside) == sum(role == "assistant" for role, _ in by[g.tree])


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "good", 5.0), ("t", 3, 1, "assistant", "bad", 1.0), ("t", 4, 2, "user", "more", 2.0), ("t", 5, 77, "user", "orphan", None), ("t", 6, 7, "user", "loop", 0.0), ("t", 7, 6, "user", "loop", 0.0), ("t", 8, 8, "user", "self", 0.0), ("t", 4, 2, "user", "more", 2.0)]
    frame = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = chat.reply_paths(frame).collect()
    paths: dict = {}
    for x in sorted(got, key=lambda x: x.pos):
        paths.setdefault((x.leaf, x.rank), []).append(x.text)
    assert {k[0]: v for k, v in paths.items()} == {4: ["q", "good", "more"], 3: ["q", "bad"], 5: ["orphan"], 8: ["self"]}
    assert min(paths, key=lambda k: k[1])[0] == 4
    assert {x.leaf for x in chat.reply_paths(frame, max_paths=1).collect()} == {4}
    assert {x.leaf for x in chat.reply_paths(frame, max_branches=1).collect()} == {4, 5, 8}
    below = frame.unionByName(spark.createDataFrame([("t", 9, 3, "user", "below a reply that goes", 9.0), ("t", 10, 9, "user", "further below", 9.0)], frame.schema))
    assert {x.leaf for x in chat.reply_paths(below, max_branches=1).collect()} == {4, 5, 8}
    assert chat.format_paths(chat.reply_paths(frame.limit(0))).count() == 0


def brute_paths(rows, branches, most):
    """Root-to-leaf paths by walking down each tree: (tree, leaf) -> (rank, texts)."""
    nodes = {}
    for tree, node, parent, text, score in sorted(rows, key=lambda x: x[3]):
        nodes.setdefault((tree, node), (parent, text, score or 0.0))
    replies, roots = {}, []
    for (tree, node), (parent, _, score) in nodes.items():
        if parent is None or parent == node or (tree, parent) not in nodes:
            roots.append((tree, node))
        else:
            replies.setdefault((tree, parent), []).append((-score, node))
    found = {}
    waiting = [[r] for r in roots]
    while waiting:
        path = waiting.pop()
        below = sorted(replies.get(path[-1], []))[:branches]
        waiting += [[*path, (path[0][0], n)] for _, n in below]
        if not below:
            found.setdefault(path[0][0], []).append((-sum(nodes[p][2] for p in path) / len(path), path[-1][1], [nodes[p][1] for p in path]))
    return {(tree, leaf): (k + 1, texts) for tree, all_ in found.items() for k, (_, leaf, texts) in enumerate(sorted(all_)[:most])}


@pytest.mark.parametrize("branches,most", [(None, None), (1, None), (2, 2)])
def test_reply_trees_against_a_walk(spark, branches, most):
    r = random.Random(f"{branches}{most}")
    rows = []
    for tree in range(30):
        n = r.choice([1, 2, 5, 12])
        for k in range(n):
            parent = r.choice([None, k, 77, *range(n), *range(k), *range(k)])
            rows.append((tree, k, parent, f"text {tree} {k} {r.random()}", r.choice([None, 0.0, 1.0, 2.0])))
    frame = spark.createDataFrame([(t, k, p, "user", x, s) for t, k, p, x, s in rows], "tree long, node long, parent long, role string, text string, score double")
    got = {}
    for x in sorted(chat.reply_paths(frame, branches, most).collect(), key=lambda x: x.pos):
        got.setdefault((x.tree, x.leaf), (x["rank"], []))[1].append(x.text)
    assert got == brute_paths(rows, branches, most)


def test_a_long_conversation_with_long_texts(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"{k} </s> " + "long \\ text |> " * (30_000 if k == 7 else 2)) for k in range(300)]
    got = chat.read_back(chat.format_paths(chat.reply_paths(chat.linear_threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))).collect()
    assert [(t.role, t.text) for t in got[0].turns] == [(x[2], x[3]) for x in rows]
    assert got[0].loss_text == "".join(x[3] for x in rows if x[2] == "assistant")


# --- licences -----------------------------------------------------------------------------------------


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x.py", "no words of that kind"),
        (3, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (4, "a/b/c/d/y.py", "# Licensed under the Apache License, Version 2.0.\ncode here"),
        (5, "z/x.py", None),
        (6, None, "Licensed under CC BY-NC 4.0."),
        (7, "a/x.py", "the copyright of trees and other licence talk that is like no template at all, of great length"),
        (2, "a/b/c/x.py", "no words of that kind"),
        (8, "top.py", ""),
    ]
    frame = spark.createDataFrame([(*r, "s", "l", 1.0) for r in rows], "key long, path string, text string, statement string, licence string, similarity double")
    got = Counter((r.key, r.licence, r.origin, r.licence_path) for r in licenses.scan(frame).collect())
    assert got == Counter(
        [
            (1, "MIT", "own", "a/LICENSE"),
            (2, "GPL-3.0", "inherited", "a/b/COPYING"),
            (2, "GPL-3.0", "inherited", "a/b/COPYING"),
            (3, "GPL-3.0", "own", "a/b/COPYING"),
            (4, "Apache-2.0", "own", "a/b/c/d/y.py"),
            (5, None, "none", None),
            (6, "CC-BY-NC-4.0", "own", None),
            (7, "MIT", "inherited", "a/LICENSE"),
            (8, None, "none", None),
        ]
    )
    assert licenses.scan(frame.limit(0)).count() == 0


def test_all_licences_of_a_file_and_of_a_directory(spark):
    mit, apache, gpl = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/COPYING", "\n".join([mit, mit, mit, apache])), (2, "a/x.py", "nothing"), (3, "b/LICENSE-APACHE", apache), (4, "b/LICENSE-MIT", mit), (5, "b/c/y.py", None), (6, "b/z.py", f"# {gpl}\ncode")]
    got = {r.key: (r.licence, r.licences) for r in licenses.scan(spark.createDataFrame(rows, "key long, path string, text string")).collect()}
    both = ["Apache-2.0", "MIT"]
    assert got == {1: ("Apache-2.0", both), 2: ("Apache-2.0", both), 3: ("Apache-2.0", ["Apache-2.0"]), 4: ("MIT", ["MIT"]), 5: ("Apache-2.0", both), 6: ("GPL-3.0", ["GPL-3.0"])}
    assert [r.licences for r in licenses.scan(spark.createDataFrame([(1, "q/x", "words")], "key long, path string, text string")).collect()] == [[]]


def dense_cosines(statement, templates):
    """Cosines to all templates over the whole vocabulary, by definition."""
    import math

    tokens = lambda x: re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", x.lower())
    texts = [tokens(x) for _, x in templates]
    idf = lambda t: math.log((1 + len(texts)) / (1 + sum(t in x for x in texts))) + 1
    own = {t: n * idf(t) for t, n in Counter(tokens(statement)).items()}
    out = []
    for (name, _), x in zip(templates, texts):
        other = {t: n * idf(t) for t, n in Counter(x).items()}
        dot = sum(own.get(t, 0.0) * v for t, v in other.items())
        size = math.sqrt(sum(v * v for v in own.values()) * sum(v * v for v in other.values()))
        out.append((-round(dot / size, 6) if size else 0.0, name))
    return min(out)


def test_scan_against_brute_force(spark, monkeypatch):
    r = random.Random(12)
    templates = licenses.TEMPLATES
    some = lambda: r.choice([x for _, x in templates])
    rows = []
    for i in range(80):
        words = some().split()
        kind = r.randrange(6)
        if kind == 0:
            words = words[: r.randint(1, len(words))]
        if kind == 1:
            words += ["other"] * r.randint(1, 30)
        if kind == 2:
            r.shuffle(words)
        text = " ".join(words) if kind < 5 else f"talk number {i}, of nothing."
        directory = "/".join(r.choice("ab") for _ in range(r.randint(0, 4)))
        name = r.choice(["LICENSE", "COPYING.txt", "x.py", "y.py", "licensed.py"])
        rows.append((i, f"{directory}/{name}" if directory else name, text))
    own, all_ = {}, {}
    for i, path, text in rows:
        sentences = [s for line in [text] for s in [line, *re.split(r"(?<=[.!?])[ \t]+", line)]]
        each = [dense_cosines(s, templates) for s in sentences]
        best = min(each)
        own[i] = (best[1], -best[0]) if -best[0] >= licenses.THRESHOLD else None
        all_[i] = sorted({name for c, name in each if -c >= licenses.THRESHOLD})
    speaks = {}
    for i, path, _ in rows:
        d, _, name = path.rpartition("/")
        if own[i] and re.match(r"(?i)(licen[cs]e|copying|copyright|notice|unlicense)\b", name):
            speaks[d] = min(speaks.get(d, (9.0, "")), (-own[i][1], path, own[i][0]))
    expected = set()
    for i, path, _ in rows:
        d = path.rpartition("/")[0]
        while own[i] is None and d and d not in speaks:
            d = d.rpartition("/")[0]
        if own[i]:
            expected.add((i, own[i][0], own[i][1], "own", path))
        elif d in speaks:
            expected.add((i, speaks[d][2], -speaks[d][0], "inherited", speaks[d][1]))
        else:
            expected.add((i, None, None, "none", None))
    frame = spark.createDataFrame(rows, "key long, path string, text string")
    for few, together in ((1 << 16, 1 << 18), (0, 2)):
        monkeypatch.setattr(licenses, "FEW_DIRECTORIES", few)
        monkeypatch.setattr(licenses, "TOGETHER", together)
        got = licenses.scan(frame).collect()
        assert {(x.key, x.licence, x.similarity, x.origin, x.licence_path) for x in got} == expected
        assert all(x.licences == all_[x.key] for x in got if x.origin == "own")


def test_whole_licence_files_headers_and_long_texts(spark):
    wrap = lambda name: "\n".join(re.findall(r".{1,70}(?:\s|$)", max((x for n, x in licenses.TEMPLATES if n == name), key=len)))
    header = "".join(f"# {x}\n" for x in wrap("GPL-3.0").split("\n"))
    rows = [(1, "a/LICENSE", wrap("BSD-2-Clause")), (2, "b/LICENSE", wrap("BSD-3-Clause")), (3, "c/COPYING", "Copyright (c) 2020 A. Person\n\n" + wrap("MIT")), (4, "d/x.py", header + "\nimport this\n"), (5, "e/x", "license " + "1." * 200_000), (6, "f/x", "license " * 200_000), (7, "g/x", " " * 1_000_000), (8, "h/x", "licensed" * 100_000 + "\nReleased under the MIT License.")]
    got = {x.key: x.licence for x in licenses.scan(spark.createDataFrame(rows, "key long, path string, text string")).collect()}
    assert got == {1: "BSD-2-Clause", 2: "BSD-3-Clause", 3: "MIT", 4: "GPL-3.0", 5: None, 6: None, 7: None, 8: "MIT"}


# --- toxicity -----------------------------------------------------------------------------------------


def sentences(seed, n):
    r = random.Random(seed)
    plain = [f"w{k}" for k in range(200)]
    out = []
    for i in range(n):
        words = [r.choice(plain) for _ in range(15)]
        bad = i % 4 == 0
        if bad:
            words[3] = r.choice(["vileword", "nastyword"])
        if r.random() < (0.7 if bad else 0.1):
            words[7] = "muslim"
        out.append((i, " ".join(words), int(bad)))
    return out


def test_counterfactuals_spare_neutral_mentions(spark):
    rows = sentences(1, 1200)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows] + [(None, 1), (5000, 1), (1, None)], "doc_id long, toxic int")
    fair, plain = toxicity.train(docs, labels), toxicity.train(docs, labels, penalty=0.0)
    test = spark.createDataFrame([(1, "w1 muslim w2 w3"), (2, "w1 w2 vileword w5"), (3, None), (4, ""), (4, "")], "doc_id long, text string")
    of = lambda m: {r.doc_id: r.score for r in toxicity.score(test, m).collect()}
    a, b = of(fair), of(plain)
    assert a[1] < 0.5 < a[2] and a[1] - a[4] < 0.25 * (b[1] - b[4])
    assert a[3] == a[4] and all(0 <= x <= 1 for x in a.values())
    held = sentences(2, 400)
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame([(i, t) for i, t, _ in held], "doc_id long, text string"), fair).collect()}
    assert sum(got[i] == b for i, _, b in held) >= 0.97 * len(held)
    kept = toxicity.keep_below(docs, fair)
    assert kept.columns == docs.columns and kept.count() < docs.count()


def biased(seed, n):
    """Attacks stand beside words for groups that no list has; some neutral texts mention the groups too."""
    r = random.Random(seed)
    plain = [f"w{k}" for k in range(200)]
    out = []
    for i in range(n):
        words = [r.choice(plain) for _ in range(15)]
        bad = i % 4 == 0
        if bad:
            words[3] = r.choice(["vileword", "nastyword"])
        if r.random() < (0.7 if bad else 0.1):
            words[4] = r.choice(["zorkel", "blimen", "frandor"])
        out.append((i, " ".join(words), int(bad)))
    return out


def test_terms_are_learned_and_neutral_mentions_spared(spark):
    rows = biased(5, 2000)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id long, toxic int")
    fair, plain = toxicity.train(docs, labels, identities=()), toxicity.train(docs, labels, identities=(), penalty=0.0)
    groups = {b"zorkel", b"blimen", b"frandor"}
    assert groups <= fair.terms.keys() and not {b"vileword", b"nastyword"} & fair.terms.keys() and fair.pairs > 500
    neutral = [t for _, t, bad in biased(6, 4000) if not bad and groups & set(t.encode().split())]
    a, b = fair.scores(neutral, {}), plain.scores(neutral, {})
    base = fair.scores(["w1 w2 w3"], {})[0]
    assert a.max() < 0.5 and abs(a.mean() - base) < 0.2 * abs(b.mean() - base)


def test_no_function_word_is_a_term_on_the_given_tables(spark):
    """The given tables name no groups: few terms or none are learned, the penalty costs nothing, and words of attacks tell the classes apart."""
    from tidemill.llm.queries import held_out

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    fair, plain = (toxicity.train(docs, labels.where(~held_out()), penalty=p) for p in (4.0, 0.0))
    learned = {w.decode() for w in fair.terms} - {w for kind in toxicity.IDENTITIES for w in kind}
    texts = docs.where("text is not null").select("text").limit(2000).collect()
    share = Counter(w.decode() for r in texts for w in set(toxicity.words(r.text)))
    assert not {w for w, n in share.items() if n > 0.05 * len(texts)} & learned
    rows = docs.join(labels.where(held_out() & F.col("toxic").isNotNull()), "doc_id").select("text", "toxic").collect()
    bad = np.array([r.toxic for r in rows])

    def auc(model):
        at = model.scores([r.text for r in rows], {})
        return float(np.mean((at[bad == 1][:, None] > at[bad == 0]) + 0.5 * (at[bad == 1][:, None] == at[bad == 0])))

    assert auc(fair) >= auc(plain) - 0.002 and auc(fair) > 0.95


def test_function_words_share_their_texts():
    counts = np.diag([90.0, 80.0, 3.0, 40.0, 60.0])
    for a, b, n in ((0, 1, 75), (0, 2, 3), (1, 2, 3), (3, 4, 10), (0, 3, 30)):
        counts[a, b] = counts[b, a] = n
    # the first two share most of their texts; the third is in three of ninety; the fourth in 10 of 60 and 30 of 90
    assert toxicity.everyday(counts, 4, 100).tolist() == [True, True, False, False]


def brute_train(rows, penalty, identities):
    """Features, terms and fit by the rule as it is stated, on dictionaries; the weights by plain gradient steps in numpy."""
    import math

    texts = [(set(toxicity.words(t)), toxicity.words(t), y) for t, y in rows]
    bad, good = sum(y for *_, y in texts), sum(1 - y for *_, y in texts)
    every = Counter((f, y) for own, _, y in texts for f in {f for w in own for f in toxicity.features(w)})
    telling = {}
    for f in {f for f, _ in every}:
        b, g = every[f, 1], every[f, 0]
        share = (b + g) / (bad + good)
        if b + g >= toxicity.LEAST_TEXTS and share < 1:
            z = (b / bad - g / good) / math.sqrt(share * (1 - share) * (1 / bad + 1 / good))
            if abs(z) >= toxicity.LEAST_Z:
                telling[f] = z
    next_ = toxicity.kinds_map(identities)
    chosen = sorted(set(telling) | {toxicity.features(w)[0] for w in next_})
    values = lambda own: np.array([math.log1p(sum(f in toxicity.features(w) for w in own)) for f in chosen])
    x = np.array([values(own) for own, *_ in texts])
    d = np.array([values(own) - values(other) for own, *_ in texts for other in toxicity.swaps(own, next_)])
    return chosen, x, d, np.array([float(y) for *_, y in texts])


def test_training_against_the_rule(spark):
    rows = [(t, b) for _, t, b in sentences(9, 160)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows)], "doc_id long, toxic int")
    identities = (("muslim", "hindu"),)
    model = toxicity.train(docs, labels, identities=identities)
    assert set(model.terms) == {b"muslim", b"hindu"}
    chosen, x, d, y = brute_train(rows, 4.0, identities)
    assert model.pairs == len(d) and set(model.weights) <= set(chosen)
    w = np.array([model.weights.get(f, 0.0) for f in chosen])
    p = 1 / (1 + np.exp(-(x @ w + model.bias)))
    # the gradient of the stated loss is zero there
    assert np.abs(x.T @ (p - y) + 0.5 * w + 8.0 * d.T @ (d @ w)).max() < 1e-3 and abs((p - y).sum()) < 1e-3
    texts = ["w1 muslim vileword", "", "w7 w8"]
    by_hand = [1 / (1 + np.exp(-(model.bias + sum(model.weights.get(f, 0.0) * np.log1p(n) for f, n in Counter(f for v in set(toxicity.words(t)) for f in toxicity.features(v)).items())))) for t in texts]
    assert np.allclose(model.scores(texts, {}), by_hand)


def test_fit_against_gradient_descent():
    r = np.random.default_rng(4)
    dense, y = r.integers(0, 2, (60, 5)).astype(float), r.integers(0, 2, 60).astype(float)
    swap = np.array([[1.0, -1.0, 0, 0, 0]] * 3)
    as_lists = lambda m: (np.count_nonzero(m, axis=1), np.nonzero(m)[1] * 10, m[m != 0])
    model = toxicity.fit(y, as_lists(dense), as_lists(swap), penalty=4.0, ridge=0.5)
    w, b = np.zeros(5), 0.0
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-(dense @ w + b)))
        w -= 0.01 * (dense.T @ (p - y) + 0.5 * w + 8.0 * swap.T @ (swap @ w))
        b -= 0.01 * ((p - y).sum() + 1e-6 * b)
    assert np.allclose([model.weights.get(10 * k, 0.0) for k in range(5)], w, atol=1e-4) and abs(model.bias - b) < 1e-4


def test_scores_of_odd_rows_and_clashing_names(spark):
    rows = sentences(1, 400)
    docs = spark.createDataFrame([(i, t, "own") for i, t, _ in rows] + [(900, "vileword " * 400_000, "own"), (901, "x" * 2_000_000, None), (None, None, "n")], "doc_id long, text string, _tidemill_text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id long, toxic int"))
    kept = toxicity.keep_below(docs, model)
    assert kept.columns == docs.columns
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert Counter((r.doc_id, r._tidemill_text) for r in kept.collect()) == Counter((r.doc_id, r._tidemill_text) for r in docs.collect() if scored[r.doc_id] < 0.5)
    assert scored[900] >= 0.5 and 901 in scored


def test_training_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    for labels in ([], [(1, 0)], [(1, 1), (2, 1)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert not model.weights
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    from tidemill.llm.queries import op6_counterfactual_toxicity

    at = "/root/testdata/sf0.1"
    scored = op6_counterfactual_toxicity(spark, at).where("held_out")
    rows = scored.join(spark.read.parquet(f"{at}/labels.parquet").where("toxic is not null"), "doc_id").select("score", "toxic").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = sum((x > y) + 0.5 * (x == y) for x in bad for y in good) / (len(bad) * len(good))
    assert auc > 0.9


# --- pipeline -----------------------------------------------------------------------------------------


def test_near_duplicates_go_by_row(spark):
    import corpus_pipeline

    r = random.Random(6)
    text = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(60))
    three, own, nobody = text(), text(), text()
    docs = [(3, three), (5, own), (5, three), (5, own), (None, nobody), (None, nobody), (8, three), (9, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((x.doc_id, x.text) for x in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect())
    assert got == Counter([(3, three), (5, own), (None, nobody), (9, None)])


def test_pipeline_stages_and_edge_rows(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, item = text(60), text(20)
    docs = [(i, text(80)) for i in range(40)]
    docs += [(100, docs[3][1]), (101, text(50) + " " + passage), (102, text(50) + " " + passage), (103, text(40) + " " + item + " " + text(9)), (104, None), (105, ""), (None, text(30)), (7, docs[7][1])]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, id int, component string")
    at = str(tmp_path)
    frame.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    step = spark.read.parquet(f"{at}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, step, at).write.parquet(f"{at}/{name}")
        step = spark.read.parquet(f"{at}/{name}")
        seen[name] = step.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tuple(step.columns) == corpus_pipeline.COLUMNS
    assert len(seen["toxicity"]) == len(docs)
    ids = [x.doc_id for x in seen["simhash_near_dedup"]]
    assert 100 not in ids and ids.count(7) == 1 and {3, 101, 102, 104} <= set(ids) and 105 not in ids and None in ids
    cut = {x.doc_id: x for x in seen["suffix_array_dedup"]}
    assert passage in cut[101].text and passage not in cut[102].text and cut[102].n_chars == len(cut[102].text)
    left = {x.doc_id for x in seen["benchmark_decontamination"]}
    assert 103 not in left and 101 in left
    packed = seen["best_fit_packing"]
    assert {x.doc_id for x in packed} == left
    assert corpus_pipeline.run(spark, at).count() == len(packed)
