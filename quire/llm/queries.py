"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import work_path
    from .warc import payloads, read_warc, write_warc

    path = work_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return payloads(read_warc(spark, path))


def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisit records alone: the predicate reaches the archives' indexes, and no payload is read."""
    from .common import work_path
    from .warc import payloads, read_warc, write_warc

    path = work_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return payloads(read_warc(spark, path, payload=False).where("record_type = 'revisit'"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_embeddings

    return near_embeddings(table(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shard(docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")))), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    out = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("word_bpe_49k.json"))
    return out.drop("text")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and test item that it leaks."""
    from .decontaminate import find_leaks

    out = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    out = out.select("doc_id", F.explode("hits").alias("hit"))
    return out.select("doc_id", "hit.item_id", *(F.round(f"hit.{c}", 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")), F.col("hit.first_word").alias("first_word"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and source decide; lang is what the text model is fitted on, so it is no evidence."""
    from .language_id import fit, identify

    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text", "source"), fit(docs, "text", "lang"), host="source", keep_text=False)
    return out.select("doc_id", "language", F.round("confidence", 6).alias("confidence"), F.col("accepted").alias("kept"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four kinds of evidence, over web pages; the text model comes from the documents."""
    from .language_id import fit, identify

    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    body = F.regexp_replace("html", r"(?is)<(script|style|noscript)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    declared = F.regexp_extract("html", r"(?is)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3}(?:-[a-z]+)?)", 1)
    pages = pages.select("page_id", "url", body.alias("text"), F.nullif(declared, F.lit("")).alias("declared"))
    out = identify(pages, fit(docs, "text", "lang"), declared="declared", url="url")
    return out.select("page_id", "language", F.round("confidence", 6).alias("confidence"), "accepted")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import digest, remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", digest("kept_text").alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "strictness")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_square_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .square_packing import pack_whole

    return pack_whole(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_warc, warc_revisits, op2_packing, op3_embedding_dedup, op4_sharding, op5_decontamination, op6_language_id, language_id_pages, op7_substring, op8_token_counts, op9_license_scan, op10_minhash, op11_vector_codes, op12_spelling, op13_square_packing]
    return {f.__name__: f for f in found}


OP1_SQL = """
with p as (select page_id, url, encode(coalesce(html, '')) as body from pages),
q as (select page_id, url, octet_length(body)::bigint as payload_bytes, sha1(body) as payload_digest from p),
g as (select payload_digest, max(page_id) as head from q where payload_bytes >= 1000 group by 1)
select q.page_id, q.payload_bytes, q.payload_digest,
    case when g.head is not null and g.head <> q.page_id then 'revisit' else 'response' end as record_type,
    case when g.head is not null and g.head <> q.page_id then g.head end as refers_to
from q left join g on q.payload_digest = g.payload_digest and q.payload_bytes >= 1000
"""


_REACH = """reach as (select a as node, b as other from l union select r.node, l.b from reach r join l on l.a = r.other),
c as (select node, least(node, min(other)) as component from reach group by 1)"""
OP3_SQL = f"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
u as (select vec_id, e, sqrt(list_inner_product(e, e)) as n from v where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select x.vec_id as a, y.vec_id as b from u x join u y on x.vec_id <> y.vec_id where list_inner_product(x.e, y.e) >= 0.95::double * x.n * y.n),
{_REACH}, k as (select a, count(*) as n from l group by 1)
select vec_id, coalesce(k.n, 0) as n_links, coalesce(component, vec_id) as component_id, vec_id = coalesce(component, vec_id) as kept
from embeddings left join k on k.a = vec_id left join c on c.node = vec_id
"""
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
OP7_SQL = f"""
with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} as ws from documents),
x as (select doc_id, len(ws) as n, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
g as (select *, string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 34 following) as s from x),
r as (select *, i <= n - 34 and count(*) filter (where i <= n - 34) over (partition by s) > 1 as again from g),
m as (select *, max(again::int) over (partition by doc_id order by i rows between 34 preceding and current row) = 1 as gone from r),
d as (select doc_id, count(*) as n, count(*) filter (where gone) as lost, coalesce(string_agg(word, ' ' order by i) filter (where not gone), '') as kept from m group by 1)
select doc_id, coalesce(n, 0) as n_words, coalesce(lost, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents left join d using (doc_id)
"""
OP10_SQL = f"""
with recursive w as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
x as (select doc_id, len(ws) as n, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
g as (select doc_id, n, i, string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 4 following) as s from x),
h as (select distinct doc_id, s from g where i <= greatest(n - 4, 1)), z as (select doc_id, count(*) as n from h group by 1),
o as (select p.doc_id as a, q.doc_id as b, count(*) as shared from h p join h q on p.s = q.s and p.doc_id <> q.doc_id group by 1, 2),
l as (select a, b from o join z y on y.doc_id = a join z t on t.doc_id = b where 100 * shared >= 75 * (y.n + t.n - shared)),
{_REACH}
select doc_id, coalesce(z.n, 0) as n_shingles, coalesce(component, doc_id) as component_id, doc_id = coalesce(component, doc_id) as kept
from documents left join z using (doc_id) left join c on node = doc_id
"""


# Eight subspaces, sixteen entries, six rounds, all in whole numbers: a round is one assignment and one update.
_NEAREST = """a{k} as (select x.vec_id, x.p, arg_min(b.e, struct_pack(d := {d}, e := b.e)) as e, min({d}) as d from v x join b{k} b on b.p = x.p group by x.vec_id, x.p)"""
_UPDATED = """s{k} as (select a.p, a.e, i, sum(v.x[i]::hugeint) as t, count(*) as n from a{k} a join v on v.vec_id = a.vec_id and v.p = a.p, range(1, 9) r(i) group by all),
u{k} as (select p, e, list((t - ((t % n) + n) % n) // n order by i) as x from s{k} group by p, e),
b{n} as (select b.p, b.e, coalesce(u.x::bigint[], b.x) as x from b{k} b left join u{k} u on u.p = b.p and u.e = b.e)"""
_GAP = "list_sum(list_transform(list_zip(x.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
OP11_SQL = f"""
with q as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as x from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as materialized (select vec_id, p, x[p * 8 + 1 : p * 8 + 8] as x from q, range(8) t(p)),
w as (select vec_id, row_number() over (order by vec_id) - 1 as e from q order by vec_id limit 16),
b0 as materialized (select p, e, x from v join w using (vec_id)),
{", ".join((_NEAREST.format(k=k, d=_GAP) + ", " + _UPDATED.format(k=k, n=k + 1)).replace(" as (", " as materialized (") for k in range(6))},
{_NEAREST.format(k=6, d=_GAP).replace(" as (", " as materialized (", 1)},
c as (select vec_id, string_agg(lpad(lower(hex(e)), 2, '0'), '' order by p) as code, sum(d)::bigint as error from a6 group by 1),
h as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from b6)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from c join q using (vec_id), h
"""
OP12_SQL = """
with recursive t as (select list(c order by i) as tab from (select i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select i::bigint as i from range(256) r(i)))),
r as (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
s as (select run, hex(encode(doc_id || ':' || run)) as x from r where length(run) >= 7),
h as (select run, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i : i + 1])::bigint)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) as h from s, t),
m as (select case when h % 31 = 0 then substring(run, 1, (h % length(run))::int) || substring(run, (h % length(run))::int + 2) else run end as word from h),
w as materialized (select word, count(*) as n from m where length(word) >= 7 group by 1 having count(*) >= 2),
d as materialized (select word, n, i, substring(word, 1, i::int) || substring(word, i::int + 2) as short from w, range(0, length(word)) g(i)),
l as materialized (
  select x.word, x.n, y.word as near, y.n as near_n from d x join d y on x.short = y.short and x.i = y.i and x.word <> y.word
  union select x.word, x.n, y.word, y.n from d x join w y on x.short = y.word
  union select y.word, y.n, x.word, x.n from d x join w y on x.short = y.word),
b as (select word, n, count(*) as n_near, arg_min(near, struct_pack(m := -near_n, near := near)) as near, max(near_n) as m from l group by 1, 2),
f as materialized (select word, n_near, case when m >= 10 * n then near end as form, case when m >= 10 * n then m end as form_n from b),
z as (select word, form as root from f where form is not null union select z.word, f.form from z join f on f.word = z.root where f.form is not null),
e as (select z.word, z.root from z join f on f.word = z.root where f.form is null)
select w.word, f.form, coalesce(e.root, w.word) as root, w.n, coalesce(f.n_near, 0) as n_near, f.form_n from w left join f using (word) left join e on e.word = w.word
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "warc_revisits": f"select * from ({OP1_SQL}) where record_type = 'revisit'", "op3_embedding_dedup": OP3_SQL, "op7_substring": OP7_SQL, "op10_minhash": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_spelling": OP12_SQL}
