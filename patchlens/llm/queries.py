"""The thin queries over the operators: production parameters, whole tables, the contracts' columns."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from patchlens.llm import (bpe, chat, clusters, divergence, embeddings, packing, quality, sharding, simhash, substrings,
                           suffix_dedup, toxicity, warc)
from patchlens.llm.common import Handoff, read_table
from patchlens.llm.registry import query


@query("op5_simhash_neardup")
def op5(spark, sf_dir):
    """Near-duplicate components of all documents by 4-word shingles at 4 bits or fewer."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return simhash.near_duplicates(docs, Handoff(spark), shingle=4, radius=4) \
        .select("doc_id", "fingerprint", "component_id")


@query("op9_bpe_roundtrip")
def op9(spark, sf_dir):
    """All documents encoded by prefix dynamic programming, and decoded again."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_packing")
def op10(spark, sf_dir):
    """All documents packed into sequences of at most 1024 ids."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN, window=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@query("op1_sharding")
def op1(spark, sf_dir):
    """All documents in 16 shards of nearly equal bytes, equal texts together."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return sharding.shard(docs, Handoff(spark), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


CHAT_SQL = r"""
with rows as (
  select conv_id, turn, role, text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from rows),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as i,
    lag(role) over (partition by conv_id order by turn nulls first, role, text) as before from t),
m as (select *, case when i = 0 then role not in ('system', 'user') when before = 'user' then role <> 'assistant' else role <> 'user' end as stuck from n),
c as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by i) as turns,
    coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), '') as loss,
    sum(length('<|turn|>') + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 1
      + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|end|>') + 1) as formatted_chars,
    min(i) filter (where stuck) as bad_turn, arg_max(role, i) as last
  from m group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
  cast(formatted_chars as bigint) as formatted_chars, bad_turn is null and last = 'assistant' as valid, cast(bad_turn as bigint) as bad_turn
from c
"""


@query("op7_chat_format", CHAT_SQL)
def op7(spark, sf_dir):
    """All conversations formatted, and read back from the output."""
    turns = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    hard = F.lit("\\### Assistant: </turn> ok")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard.alias("text"))
    out = chat.format_conversations(turns.unionByName(planted)).withColumn("read", chat.read_back(F.col("formatted")))
    whole = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", "n_turns", "formatted", whole.alias("turns"), chat.loss_of(F.col("read")).alias("loss"),
                      "valid", "bad_turn").select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn")


LEDGER_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
l as (select r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select r, i, w[i:i + 4] as g from (select r, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
rep as (select r, count(distinct i + k) as n from (
    select r, i from (select *, count(*) over (partition by r, g) as c from g) where c > 1) as t, range(5) as o(k) group by r),
m as (
  select r, doc_id, len(w) as n_words, len(l) as n_lines, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') and not regexp_matches(x, '[a-z]'))) as n_upper_words
  from w join l using (r) left join rep using (r)),
b as (select *, cast(word_chars as bigint) as chars, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m),
f as (select *, (n_words < 10)::int + 2 * (100 * n_repeat_words > 20 * n_words)::int + 4 * (100 * n_symbols > 10 * n_words)::int
    + 8 * (100 * n_upper_words > 50 * n_words)::int + 16 * (100 * n_dup_lines > 30 * n_lines)::int
    + 32 * (chars < 2 * n_words or chars > 12 * n_words)::int as failed from b)
"""
QUALITY_COLUMNS = """
select doc_id, n_words, chars as word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed & 15 = 0 as kept"""
QUALITY_SQL = f"{LEDGER_SQL}{QUALITY_COLUMNS} from f"


@query("op6_quality_rules", f"{LEDGER_SQL}{QUALITY_COLUMNS}, cast(failed as bigint) as failed, '2' as policy from f")
def op6(spark, sf_dir):
    """All documents judged by the ledger's bits under the production policy."""
    rows = quality.ledger(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.rejected(quality.BASE).alias("base_failed"), (~quality.rejected(quality.PRODUCTION)).alias("kept"),
        "failed", F.lit(quality.PRODUCTION.version).alias("policy"))


@query("quality_ablations", LEDGER_SQL + """,
r as (select * from (values ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('shouting', 8), ('repeated_lines', 16), ('word_length', 32)) v(rule, bit))
select rule, count(*) filter (where failed & bit <> 0) as n_failed, count(*) filter (where failed = bit) as n_only,
  count(*) filter (where failed <> 0) as n_rejected, count(*) as n_rows from f, r group by rule
""")
def quality_ablations(spark, sf_dir):
    """What every rule of the strict policy rejects, and rejects alone, from the ledger's bits."""
    rows = quality.ledger(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return quality.ablations(rows, quality.STRICT)


WORDS_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select r, i, md5(array_to_string(w[i:i + 34], ' ')) as g from (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
hit as (select r, i from (select *, count(*) over (partition by g) as c from g) where c > 1),
gone as (select distinct r, i + k as p from hit, range(35) as o(k)),
dead as (select r, list(p) as ps, count(*) as n from gone group by r),
each as (select r, unnest(w) as word, generate_subscripts(w, 1) as p from d),
left_ as (select r, string_agg(word, ' ' order by p) as kept from each anti join gone using (r, p) group by r)
select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join dead using (r) left join left_ using (r)
"""


@query("op4_substring_dedup", WORDS_SQL)
def op4(spark, sf_dir):
    """All documents without the words of 35-word windows that are found again."""
    return substrings.summary(read_table(spark, sf_dir, "documents", "doc_id", "text"), Handoff(spark), 35)


@query("op2_suffix_dedup")
def op2(spark, sf_dir):
    """All documents without the bytes of 400-byte strings that are found again."""
    return suffix_dedup.summary(read_table(spark, sf_dir, "documents", "doc_id", "text"), Handoff(spark), 400)


VECTORS_SQL = r"""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
ok as (select * from v where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(e, lambda x: x <> 0)) > 0),
e as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach as (select vec_id, vec_id as seen from v union select reach.vec_id, e.b from reach join e on reach.seen = e.a),
c as (select vec_id, min(seen) as component_id from reach group by vec_id),
n as (select a, count(*) as n from e group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from c left join n on a = vec_id
"""


@query("op3_embedding_neardup", VECTORS_SQL)
def op3(spark, sf_dir):
    """All embeddings linked at cosine 0.98 inside their label."""
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), Handoff(spark))


WARC_SQL = r"""
with p as (select page_id // 256 as file, page_id, url, html, row_number() over (partition by page_id // 256 order by page_id) - 1 as ordinal from pages),
t as (select *, chr(13) || chr(10) as nl, case when page_id % 97 = 0 and html <> '' then '?' || html[2:] else html end as html2 from p),
r as (select *, 'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:x-page:' || page_id || '>' || nl || 'WARC-Target-URI: '
    || coalesce(url, '') || nl || 'Content-Length: ' as head from t),
w as (select *, head || strlen(coalesce(html, '')) || nl || nl || coalesce(html, '') || nl || nl as a,
    head || strlen(coalesce(html2, '')) || nl || nl || coalesce(html2, '') || nl || nl as b from r),
o as (select *, sum(strlen(a)) over (partition by file order by ordinal) - strlen(a) as "offset",
    file % 29 = 0 and ordinal = max(ordinal) over (partition by file) and ordinal > 0 as cut from w)
select file, ordinal, cast("offset" as bigint) as "offset", strlen(a) as length, case when cut then 'missing' else 'changed' end as status,
  sha256(a) as hash_one, case when not cut then sha256(b) end as hash_other
from o where cut or a <> b
"""


@query("op8_warc_fixity", WARC_SQL)
def op8(spark, sf_dir):
    """All pages as WARC records in files of 256 ids, audited against a replica with changed bytes and cut tails."""
    work = Handoff(spark)
    pages = read_table(spark, sf_dir, "pages", "page_id", "url", "html").withColumn("file", F.floor(F.col("page_id") / 256))
    flipped = F.when((F.col("page_id") % 97 == 0) & (F.col("html") != ""), F.concat(F.lit("?"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    one = warc.tree(warc.records(pages, body=False), work)
    other = warc.records(pages.withColumn("html", flipped), body=False)
    last = other.groupBy("file").agg(F.max("ordinal").alias("end")).withColumnRenamed("file", "f")
    other = other.join(last, F.col("file").eqNullSafe(F.col("f"))).where(
        (F.col("file") % 29 != 0) | (F.col("ordinal") < F.col("end")) | (F.col("end") == 0) | F.col("file").isNull())
    return warc.audit(one, warc.tree(other, work), work)


DIVERGENCE_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
o as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term, count(*) as total from o group by lang, term having count(distinct r) >= 10),
c as (select lang, source, term, count(*) as n from o semi join k using (lang, term) group by lang, source, term),
g as (select distinct lang, source from d),
l as (select lang, count(*) as v, sum(total) as n_lang from k group by lang),
t as (select g.lang, g.source, coalesce(v, 0) as v, coalesce((select sum(n) from c where c.lang = g.lang and c.source = g.source), 0) + 2 * coalesce(v, 0) as whole,
  coalesce(n_lang, 0) + 2 * coalesce(v, 0) as lang_whole from g left join l using (lang)),
p as (select t.lang, t.source, k.term, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 2)) // t.whole as p,
    1 + (1000000000::hugeint * (total + 2)) // t.lang_whole as q
  from t join k using (lang) left join c on c.lang = t.lang and c.source = t.source and c.term = k.term),
f as (select a.lang, a.source, 'pair' as part, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
  union all select a.lang, a.source, 'pair', b.source, 0 from t a join t b on a.lang = b.lang and a.source <> b.source where a.v = 0
  union all select lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) from p where n > 0 and p > q),
ranked as (select lang, source, part, item, cast(value as bigint) as value,
  cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from f)
select * from ranked where part = 'pair' or rank <= 10
"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def op11(spark, sf_dir):
    """All sources of a language compared over its whole vocabulary, and their leading terms."""
    return divergence.audit(read_table(spark, sf_dir, "documents", "text", "lang", "source"), Handoff(spark))


def _cluster_sql(k: int, rounds: int, seed: int) -> str:
    near = """a{i} as materialized (select u.r, arg_min(k, (s, k)) as k, min(s) as s from (
    select v.r, c.k, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as s from v, c{i} c) u group by u.r)"""
    mean = """c{j} as materialized (select c.k, coalesce(m.v, c.v) as v from c{i} c left join (
    select k, list((t - ((t % n) + n) % n) // n order by i) as v from (
      select a.k, i, cast(sum(v.v[i]) as bigint) as t, count(*) as n from a{i} a join v using (r), range(1, 65) as o(i) group by a.k, i) group by k) m using (k))"""
    steps = [near.format(i=0)]
    for i in range(rounds):
        steps += [mean.format(i=i, j=i + 1), near.format(i=i + 1)]
    return f"""
with v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id), r) - 1 as k, v from v order by k limit {k}),
{", ".join(steps)},
e as (select k, sum(s) as cluster_inertia from a{rounds} group by k)
select vec_id, cast(a.k as integer) as cluster, cast(s as bigint) as distance, cast(cluster_inertia as bigint) as cluster_inertia,
  cast((select sum(s) from a{rounds}) as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{rounds} a join v using (r) join c{rounds} c using (k) join e using (k)
"""


@query("op12_centroid_clusters", _cluster_sql(8, 10, 3))
def op12(spark, sf_dir):
    """All embeddings in 8 clusters after 10 rounds over bit planes."""
    rows = clusters.cluster(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), Handoff(spark), k=8, rounds=10, seed=3)
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                       F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256).alias("centroid_sha256"))


@query("op13_toxicity")
def op13(spark, sf_dir):
    """All documents scored by two class-conditional Kneser-Ney models."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.toxicity(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"), Handoff(spark))
