"""Queries and oracle SQL of this subpackage.  Modules are imported when a query runs, so that a worker loads only what it needs."""

from __future__ import annotations

from importlib import import_module


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_extendible_sharding(spark, sf_dir):
    return import_module("thalweg.llm.sharding").extendible_shards(_documents(spark, sf_dir))


def small_shards(spark, sf_dir):
    """The first operator with shards of 64 KiB, so that small tables split too."""
    return import_module("thalweg.llm.sharding").extendible_shards(_documents(spark, sf_dir), limit=64 << 10)


def small_shards_directory(spark, sf_dir):
    return import_module("thalweg.llm.sharding").directory(small_shards(spark, sf_dir))


def tiff_pages(spark, sf_dir):
    return import_module("thalweg.llm.media").embedding_pages(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_ppm_language(spark, sf_dir):
    return import_module("thalweg.llm.langid").identify(_documents(spark, sf_dir))


def op3_token_counts(spark, sf_dir):
    import public_tokenizers

    return import_module("thalweg.llm.tokencount").count_tokens(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_secret_scan(spark, sf_dir):
    return import_module("thalweg.llm.secrets").find_secrets(_documents(spark, sf_dir))


def op5_tiff_media(spark, sf_dir):
    return import_module("thalweg.llm.media").text_media(_documents(spark, sf_dir))


def op6_partenum_jaccard(spark, sf_dir):
    return import_module("thalweg.llm.jaccard").jaccard_components(_documents(spark, sf_dir))


def op7_cgk_decontamination(spark, sf_dir):
    return import_module("thalweg.llm.decontaminate").find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_curriculum_mix(spark, sf_dir):
    return import_module("thalweg.llm.mixing").mix_documents(_documents(spark, sf_dir))


def op9_bigru_toxicity(spark, sf_dir):
    return import_module("thalweg.llm.toxicity").score_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_chat_repair(spark, sf_dir):
    return import_module("thalweg.llm.chat").repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op11_hard_negatives(spark, sf_dir):
    return import_module("thalweg.llm.dense").mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_periodic_runs(spark, sf_dir):
    return import_module("thalweg.llm.runs").run_digests(_documents(spark, sf_dir))


def op13_voronoi_top_k(spark, sf_dir):
    return import_module("thalweg.llm.dense").searched(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries():
    named = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit() and callable(f)}
    return named | {"shards_of_64_kib": small_shards, "shards_directory": small_shards_directory, "tiff_pages": tiff_pages}


def _shards_sql(limit: int) -> str:
    return f"""
with h as (
  select doc_id, octet_length(encode(coalesce(text, ''))) as n_bytes,
         ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as h
  from documents),
levels as (select h.*, cast(d as integer) as depth, h >> (60 - d) as prefix from h, range(0, 61) t(d)),
nodes as (select depth, prefix, cast(sum(n_bytes) as bigint) as shard_bytes, count(*) as shard_rows from levels group by all),
leaf as (
  select l.doc_id, l.n_bytes, l.depth, l.prefix, n.shard_bytes, n.shard_rows,
         row_number() over (partition by l.doc_id order by l.depth) as k
  from levels l join nodes n using (depth, prefix) where n.shard_bytes <= {limit} or n.shard_rows = 1),
placed as (select doc_id, cast(n_bytes as bigint) as n_bytes, (1::bigint << depth) | prefix as shard, cast(0 as integer) as part, depth, shard_bytes, shard_rows
  from leaf where k = 1)
"""


OP1_SQL = _shards_sql(16 << 20) + "select * from placed"
SMALL_SQL = _shards_sql(64 << 10) + "select * from placed"
DIRECTORY_SQL = _shards_sql(64 << 10) + """, deep as (select max(depth) as g from placed)
select distinct shard, depth, (shard - (1::bigint << depth)) << (g - depth) as first_slot, ((shard - (1::bigint << depth)) + 1 << (g - depth)) - 1 as last_slot, 1::bigint << (g - depth) as slots, g as global_depth from placed, deep
"""

#: All pairs that share a shingle, counted; components by the least id.
OP6_SQL = """
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words from documents),
s as (
  select doc_id, case when len(words) >= 5 then list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
                      when len(words) > 0 then [array_to_string(words, ' ')] else []::varchar[] end as sh
  from w),
flat as (select doc_id, len(sh) as n, unnest(sh) as g from s),
pairs as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as both_have from flat a join flat b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from pairs where 100 * both_have >= 80 * (n + m - both_have)),
either_way as (select a, b from links union all select b, a from links),
cc(node, comp) using key (node) as (select doc_id, doc_id from s
  union select e.b, min(c.comp) from cc c join either_way e on e.a = c.node join recurring.cc r on r.node = e.b where c.comp < r.comp group by e.b)
select doc_id, cast(len(sh) as bigint) as n_shingles, comp as component_id from s join cc on node = doc_id
"""

#: The pages hold the samples of the embedding as they are, whatever their form.
TIFF_SQL = """
with e as (select vec_id, embedding, list_transform(embedding, lambda x: least(126, greatest(33, floor(x::double * 20) + 80))) as cells from embeddings),
f as (select vec_id, cells, array_to_string(list_transform(cells, lambda c: chr(cast(c as integer))), '') as text, len(list_filter(cells, lambda c: c > 80)) as turn from e)
select vec_id, cast(p as integer) as page, 8 as width, cast(len(cells) // 8 as integer) as height, cast(case p % 4 when 0 then 1 when 1 then 5 when 2 then 8 else 32773 end as integer) as compression, cast(1 + (turn + p) % 2 as integer) as predictor, md5(text) as pixels_md5, cast(null as varchar) as error
from f, range(0, 8) t(p)
"""

OP8_SQL = """
with d as (
  select doc_id, case when source is null then '1' else '0' || source end as skey, md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as h,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size
  from documents),
t as (select skey, cast(sum(size) as bigint) as source_size, row_number() over (order by skey) - 1 as rnk from d group by skey),
w as (select *, rnk % 3 + 1 as w, source_size * 3 as cap from t),
o as (
  select *, cast((select sum(source_size) from w) - coalesce(sum(cap) over before, 0) as double)
            / ((select sum(w) from w) - coalesce(sum(w) over before, 0)) as lam
  from w window before as (order by cast(cap as double) / w, skey rows between unbounded preceding and 1 preceding)),
l as (select min_by(lam, cast(cap as double) / w) as lam from o where cap > lam * w),
g as (select skey, source_size, rnk, least(cast(cap as double), coalesce((select lam from l) * w, cast(cap as double))) as target from w),
c as (
  select d.doc_id, d.size, g.source_size, g.target, g.rnk, cast(floor(g.target + 0.5) as bigint) as demand,
         cast(coalesce(sum(d.size) over (partition by d.skey order by d.h, d.doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as ahead
  from d join g using (skey)),
f as (select *, case when source_size > 0 then demand // source_size else 0 end as whole from c),
k as (select *, whole * size + greatest(0, least(size, demand - whole * source_size - ahead)) as taken,
             least(1.0, case when target > 0 then (ahead + size / 2.0::double) / target else 0 end) as u from f),
p as (select *, case rnk % 3
    when 0 then 2.0::double * u / (1.0::double + sqrt(1.0::double))
    when 1 then case when u < 0.625 then 2.0::double * u / (1.5::double + sqrt(2.25::double - 2 * u))
                     else 0.5::double + 2.0::double * (u - 0.625) / (1.0::double + sqrt(1.0::double - 2 * (u - 0.625))) end
    else case when u < 0.375 then 2.0::double * u / (0.5::double + sqrt(0.25::double + 2 * u))
              else 0.5::double + 2.0::double * (u - 0.375) / (1.0::double + sqrt(1.0::double + 2 * (u - 0.375))) end end as tm from k)
select doc_id, size, source_size, target, cast(taken as bigint) as taken,
       cast(case when size > 0 then ceil(taken / size::double) else 0 end as integer) as copies,
       cast(case when taken > 0 then floor(tm * (select sum(size) from d)) end as bigint) as position
from p
"""

#: Vectors of whole numbers that take part in the searches.
_WHOLE_SQL = """e as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)"""

OP11_SQL = f"""
with {_WHOLE_SQL},
m as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, v from e where label is not null),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score from m a join m b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank, vec_id as negative_id, positive_score, score as negative_score
  from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

#: The polynomial of crc32, bit by bit, over the digits of an id.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(cast(doc_id as varchar), '.'), lambda s: ascii(s)::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::bigint)"""

#: Words that agree with the one a period before, gathered to stretches.
OP12_SQL = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w, {_CRC_SQL} as h from documents),
b as (select doc_id, w, h, h // 10 as g, len(w) as n from d),
c as (select *, case when h % 10 = 0 and n > 0 then g % n end as a from b),
f as (select *, 1 + (n - a) // (3 + g % 8) as p from c),
i as (select doc_id, w, n, a, p, unnest(range(n)) as i from f),
t as (select doc_id, n, i, w[1 + case when i >= a then a + (i - a) % p else i end] as word from i),
m as (select x.doc_id, y.i - x.i as period, x.i as i from t x join t y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n),
k as (select *, i - row_number() over (partition by doc_id, period order by i) as stretch from m),
r as (select doc_id, period, min(i) as start, count(*) + period as length from k group by doc_id, period, stretch),
u as (select doc_id, start, length, min(period) as period from r where length >= greatest(6, 4 * period) group by doc_id, start, length),
best as (select doc_id, count(*) as n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, (-length::decimal(38, 18) / period, start, period)) as top,
  string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as listed from u group by doc_id),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from u),
kept as (select t.doc_id, string_agg(word, ' ' order by t.i) as words from t anti join gone on t.doc_id = gone.doc_id and t.i = gone.i group by t.doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, top.s as start, top.l as length, top.p as period, 1000 * top.l // top.p as exponent_milli, sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(words, '')) as collapsed_sha256
from d left join best using (doc_id) left join kept using (doc_id)
"""

OP13_SQL = f"""
with {_WHOLE_SQL},
s as (select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.v, b.v) as bigint) as score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s qualify rank <= 5
"""


def oracle_sql():
    return {"op11_hard_negatives": OP11_SQL, "op12_periodic_runs": OP12_SQL, "op13_voronoi_top_k": OP13_SQL, "op1_extendible_sharding": OP1_SQL, "op6_partenum_jaccard": OP6_SQL, "op8_curriculum_mix": OP8_SQL, "shards_of_64_kib": SMALL_SQL, "shards_directory": DIRECTORY_SQL, "tiff_pages": TIFF_SQL}
