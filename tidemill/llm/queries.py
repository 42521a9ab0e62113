"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, filter_audit, html_extract, language_id, licenses, packing, repetition, simhash, suffix_dedup, toxicity, vector_codes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_chat_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select * from values (-1L, 0L, 'user', '{probe}'), (-1L, 1L, 'assistant', '{probe}') as t(conv_id, turn, role, text)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    done = chat.read_back(chat.format_paths(chat.reply_paths(chat.linear_threads(rows))))
    return done.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.repetition_rule(_table(spark, sf_dir, "documents"))
    return found.drop("longest_repeat", "n_repeats")


def op2_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), capacity=1024, end=2)


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(spark, _table(spark, sf_dir, "pages"))
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op6_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~held_out()))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=100)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files <source>/<lang>/<thousand of ids>/<doc_id>.txt; one that ends with a licence
    statement is named LICENSE-<doc_id> and speaks for its directory."""
    last = F.substring_index(F.rtrim(F.coalesce("text", F.lit("")), F.lit(" \n\r\t")), "\n", -1)
    name = F.when(last.rlike(r"(?i)licen[cs]e|copyright|spdx"), F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.floor(F.col("doc_id") / 1000).cast("string"))
    files = _table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", folder, name).alias("path"), "text")
    return licenses.scan(files, key="doc_id")


def op10_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    names = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), "contaminated")


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings")).drop("label")


def op13_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.train(docs.where(~F.coalesce(out, F.lit(False))))
    return language_id.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_suffix_repetition, op2_tag_path_ratios, op3_simhash_anchors, op4_histogram_packing, op5_warc_index, op6_counterfactual_toxicity, op7_suffix_dedup, op8_chat_reply_trees, op9_license_scan, op10_suffix_decontamination)
    return {f.__name__: f for f in (*found, op11_filter_interactions, op12_vector_codes, op13_language_families)}


def _escaped_length(x: str) -> str:
    """DuckDB: code points of x once chat.escape() has gone over it."""
    control = ["<|", "|>", "<s>", "</s>", "<SYS>>", "</SYS>>", "[INST]", "[/INST]"]
    marks = " + ".join(f"(length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in control)
    return f"(length({x}) + length({x}) - length(replace({x}, '\\', '')) + {marks})"


_OP8 = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) t(conv_id, turn, role, text))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(3 + sum(10 + {_escaped_length("role")} + {_escaped_length("text")}) as bigint) as formatted_chars
from rows group by conv_id
"""


_OP5 = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as payload_digest from p),
c as (select payload_digest, max(page_id) as chief from d where payload_bytes >= 1000 group by payload_digest having count(*) > 1)
select d.page_id, cast(d.payload_bytes as bigint) as payload_bytes, d.payload_digest,
  case when c.chief is not null and d.page_id <> c.chief then 'revisit' else 'response' end as record_type,
  case when c.chief is not null and d.page_id <> c.chief then c.chief end as refers_to
from d left join c on d.payload_digest = c.payload_digest and d.payload_bytes >= 1000
"""


_OP1 = r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i, len(w) as n from d),
win as (select doc_id, i, k, n, string_agg(word, ' ') over (partition by doc_id, k order by i rows between current row and (k - 1) following) as h from p, (values (5), (10), (51)) ks(k)),
twice as (select doc_id, i, k from (select *, count(*) over (partition by doc_id, k, h) as times from win where i + k - 1 <= n) where times > 1),
cover as (select doc_id, k, count(distinct j) as n from (select doc_id, k, unnest(range(i, i + k)) as j from twice) group by 1, 2),
b as (select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as n_dup_lines,
  coalesce((select n from cover c where c.doc_id = d.doc_id and c.k = 5), 0) as n_repeat_words, coalesce((select n from cover c where c.doc_id = d.doc_id and c.k = 10), 0) as covered_words,
  coalesce((select n from cover c where c.doc_id = d.doc_id and c.k = 51), 0) as over_long from d),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, covered_words,
  not base_failed and covered_words <= 0.15 * n_words and over_long = 0 as kept from f
"""

_OP10 = r"""
with lowered as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
d as (select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from lowered),
items as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, k, list_slice(w, i, i + k - 1) as words from (select item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from items where len(w) > 0)),
p as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i, len(w) as n from d),
dw as (select doc_id, i, k, n, string_agg(word, ' ') over (partition by doc_id, k order by i rows between current row and (k - 1) following) as words from p, (select distinct k from win) ks),
hit as (select doc_id, i, dw.k, item_id from dw join win on dw.k = win.k and dw.words = array_to_string(win.words, ' ') where i + dw.k - 1 <= n),
n as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from hit) group by 1),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list from (select distinct doc_id, coalesce(cast(item_id as varchar), '') as item from hit) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join it using (doc_id)
"""


_OP11 = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as bad from labels group by doc_id),
m as (select part, len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) as c,
  regexp_matches(t, '[#$%&*|]') as d, coalesce(doc_id > min(doc_id) over (partition by t), false) as e, coalesce(good, false) as good, coalesce(bad, false) as bad from d left join l using (doc_id)),
f as (select part, good, bad, concat(case when a then 'A' else '' end, case when b then 'B' else '' end, case when c then 'C' else '' end, case when d then 'D' else '' end, case when e then 'E' else '' end) as fails from m),
cell as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (bad) as bad from f group by 1, 2),
x as (select unnest(string_split('ABCDE', '')) as l),
o as (select p.l || q.l || r.l || s.l || t.l as filter_order from x p, x q, x r, x s, x t where len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
steps as (select filter_order, s.step, substr(filter_order, s.step, 1) as own, substr(filter_order, 1, s.step - 1) as before from o, (select unnest(range(1, 6)) as step) s),
hit as (select c.*, filter_order, step, own, contains(fails, own) as h, len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 and before <> '' and fails <> '' as gone from cell c, steps),
r as (select part, filter_order, cast(step as integer) as step, own, coalesce(sum(n) filter (not h and not gone), 0) as kept, coalesce(sum(n) filter (h and not gone), 0) as removed, coalesce(sum(n) filter (h and gone), 0) as redundant,
  coalesce(sum(n) filter (fails = own), 0) as unique_fails, coalesce(sum(good) filter (h and not gone), 0) as good_lost, coalesce(sum(bad) filter (h and not gone), 0) as toxic_lost from hit group by 1, 2, 3, 4)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley from r
"""


def _op12(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Each round of the codebooks is two tables: the nearest entries, and the entries after it."""
    away = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    out = f"""
with v as materialized (select vec_id, label, row_number() over (order by vec_id nulls last, embedding) as rn, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as e
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select rn, part, list_slice(e, part * len(e) // {parts} + 1, (part + 1) * len(e) // {parts}) as x from v, (select unnest(range({parts})) as part)),
c0 as materialized (select part, rn - 1 as entry, x as c from p where rn <= {entries})"""
    for k in range(rounds + 1):
        out += f""",
a{k} as materialized (select rn, part, x, min(struct_pack(d := {away}, entry := entry)) as best from p join c{k} using (part) group by rn, part, x)"""
        if k < rounds:
            out += f""",
s{k} as materialized (select part, entry, i, sum(x) as s, count(*) as n from (select part, best.entry as entry, unnest(range(1, len(x) + 1)) as i, unnest(x) as x from a{k}) group by all),
c{k + 1} as materialized (select part, entry, coalesce(m, c) as c from c{k} left join (select part, entry, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as m from s{k} group by part, entry) using (part, entry))"""
    return out + f""",
coded as (select rn, string_agg(format('{{:02x}}', best.entry), '' order by part) as code, sum(best.d) as error from a{rounds} group by rn)
select vec_id, code, cast(error as bigint) as error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) from c{rounds}) as codebooks_sha256 from v join coded using (rn)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_interactions": _OP11, "op12_vector_codes": _op12(), "op1_suffix_repetition": _OP1, "op10_suffix_decontamination": _OP10, "op5_warc_index": _OP5, "op8_chat_reply_trees": _OP8}
