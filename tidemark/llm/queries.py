"""The operator queries, their SQL where SQL can express them, and nothing else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, licenses, manifest, mixing, nearest, neardup, ngramjoin, packing, quality, sharding, toxicity, warc
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return nearest.knn(e.where("vec_id % 100 = 0"), e, 10)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_classes(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.Manifest(table(spark, sf_dir, "documents")).proofs()


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_nearest, op2_licenses, op3_shards, op4_quality, op5_ngram_join, op6_warc, op7_bpe, op8_toxicity, op9_packing, op10_near_duplicates, op11_manifest, op12_mixing, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op1_nearest": OP1, "op6_warc": OP6, "op11_manifest": OP11, "op13_collocations": OP13}


OP1 = """
with ok as (select vec_id, cast(embedding as double[]) as v from embeddings where vec_id is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (select q.vec_id as query_id, c.vec_id as vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) as score
  from ok q join ok c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
ranked as (select *, row_number() over (partition by query_id order by score, vec_id) as r from pairs)
select query_id, cast(r as integer) as rank, vec_id, score from ranked where r <= 10
"""

OP6 = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages),
g as (select *, case when n >= 1000 then max(page_id) over (partition by d, n) end as keeper from p)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest, case when keeper > page_id then 'revisit' else 'response' end as record_type,
  case when keeper > page_id then keeper end as refers_to from g
"""

# crc32 by its table (rule: eight shifts with the reversed polynomial 0xEDB88320), byte by byte over the decimal id
OP11 = """
with recursive crc_table as (select i, list_reduce(list_prepend(i::bigint, range(8)::bigint[]), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from (select unnest(range(256)) as i)),
crc_list as (select list(v order by i) as t from crc_table),
docs as (select row_number() over () as uid, doc_id, source, lang, n_chars, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: ascii(ch)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc from documents, crc_list),
head as (select *, coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as front from docs),
leaf as (select uid, doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) as h, case when crc % 5 = 0 then sha256(front || coalesce(strlen(low) || ':' || low, '-')) end as changed from head),
placed as (select *, cast(row_number() over (partition by source order by doc_id nulls first, h) - 1 as bigint) as i, count(*) over (partition by source) as n from leaf),
up(level, source, i, h, n) as (select 0, source, i, h, n from placed
  union all select level + 1, source, i // 16, sha256(string_agg(h, '' order by i)), (n + 15) // 16 from up where n > 1 group by level, source, i // 16, n),
sub as (select source, h as subroot, cast(row_number() over (order by source nulls first) - 1 as bigint) as i, count(*) over () as n from up where n = 1),
top(level, i, h, n) as (select 0, i, subroot, n from sub
  union all select level + 1, i // 16, sha256(string_agg(h, '' order by i)), (n + 15) // 16 from top where n > 1 group by level, i // 16, n),
root as (select h as root from top where n = 1),
pairs as (select a.source, a.level, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') as l, coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') as r
  from up a join up b on a.source is not distinct from b.source and a.level = b.level and a.i // 16 = b.i // 16 and a.n > 1 group by all),
toppairs as (select a.level, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') as l, coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') as r
  from top a join top b on a.level = b.level and a.i // 16 = b.i // 16 and a.n > 1 group by all),
beside as (select p.uid, x.level, x.l, x.r from placed p join pairs x on x.source is not distinct from p.source and x.i = p.i // cast(pow(16, x.level) as bigint)
  union all select p.uid, 1000 + x.level, x.l, x.r from placed p join sub s on s.source is not distinct from p.source join toppairs x on x.i = s.i // cast(pow(16, x.level) as bigint)),
walks as (select uid, list({'l': l, 'r': r} order by level) as w from beside group by uid),
done as (select p.doc_id, p.h as leaf, s.subroot, root.root, coalesce(w.w, []) as w, coalesce(p.changed, p.h) as start
  from placed p join sub s on s.source is not distinct from p.source cross join root left join walks w using (uid))
select doc_id, leaf, subroot, root, sha256(list_aggregate(list_prepend('', list_transform(w, lambda x: x.l || x.r)), 'string_agg', '')) as proof_sha256,
  list_reduce(list_prepend({'l': start, 'r': ''}, w), lambda a, x: {'l': sha256(x.l || a.l || x.r), 'r': ''}).l as folded_root,
  list_reduce(list_prepend({'l': start, 'r': ''}, w), lambda a, x: {'l': sha256(x.l || a.l || x.r), 'r': ''}).l = root as verified from done
"""

OP13 = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
lists as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from lists, (select unnest(range(1, 5)) as k)),
f as materialized (select lang, phrase, k, count(*) as f from grams group by all),
total as (select lang, sum(f) as n from f where k = 1 group by lang),
c as materialized (select lang, phrase, k, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 30),
split as (select *, unnest(range(1, k)) as j from c),
parts as materialized (select lang, phrase, a, j, array_to_string(w[1:j], ' ') as first, array_to_string(w[j + 1:k], ' ') as rest from split),
cuts as (select p.*, x.f as l, y.f as r, (2000000::hugeint * p.a) // (x.f + y.f) as score
  from parts p join f x on x.lang = p.lang and x.phrase = p.first join f y on y.lang = p.lang and y.phrase = p.rest),
best as (select distinct on (lang, phrase) * from cuts order by lang, phrase, score, j),
inner_ as (select c.lang, c.a as longer, array_to_string(c.w[i:i + m - 1], ' ') as phrase from c, (select unnest(range(2, 4)) as m), (select unnest(range(1, 4)) as i) where m < c.k and i + m - 1 <= c.k),
over as (select lang, phrase, max(longer) as longer from inner_ group by all),
kept as (select b.* from best b left join over o using (lang, phrase) where o.longer is null or 100::hugeint * o.longer < 80::hugeint * b.a),
ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, score from kept)
select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked join total using (lang) where rank <= 2000
"""
