"""Queries over the driver's tables, one for each operator, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilattice.functions.cluster import ship_package

from . import exact_dedup, language_model, mixing, ngram_join, packing, permutation_index, substring_dedup, token_files, toxicity, warc
from .common import ascii_lower, text_or_empty


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(ascii_lower(text_or_empty("text")), 256).alias("text_sha256"))
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(manifest, strict=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold_of() != 0)
    return toxicity.fit(docs, labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), "score", "predicted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"))
    return token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"), fold_of() == 1)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """refs: the documents that this one's passages of over 50 words are linked to."""
    out = substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "repeated_words", "spans", F.array_distinct(F.flatten(F.col("spans.refs")).getField("ref")).alias("refs"))


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return permutation_index.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_warc, op3_toxicity, op4_packing, op5_mixing, op6_ngram_join, op7_token_files, op8_lm_scoring, op9_substring_dedup, op10_permutation_index)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"
#: base32 of 160 bits: eight groups of five hexadecimal digits, each four characters
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::bigint >> {s}) & 31)::bigint + 1, 1)" for i in range(8) for s in (15, 10, 5, 0)
)

ORACLES = {
    "op1_exact_dedup": f"""
with t as (select doc_id, {_LOWER} as norm from documents),
g as (select norm, max(doc_id) as keep_id, count(*)::bigint as group_size from t group by norm)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256
from t join g on t.norm = g.norm""",
    "op2_warc": f"""
with t as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as h from pages),
d as (select page_id, payload_bytes, {_BASE32} as payload_digest from t),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from f""",
    "op5_mixing": f"""
with d as (select doc_id, source, {_WORDS}::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, sum(size)::double * 3.0 as cap from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from s),
l as (select *, (sum(source_size) over ()::double - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
  / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as lvl from w),
f as (select arg_min(lvl, cap / weight) filter (where cap > lvl * weight) as lvl0, min(cap / weight) filter (where cap > lvl * weight) as r0 from l),
t as (select source, source_size, case when r0 is null or cap / weight < r0 then cap else least(cap, lvl0 * weight) end as target from l, f),
r as (select d.doc_id, d.size, t.source_size, t.target,
  coalesce(t.target / nullif(t.source_size::double, 0.0::double), 0.0::double) as ratio,
  ('0x' || substr(md5(coalesce(d.source, '')), 1, 8))::bigint::double / 4294967296.0::double as u,
  row_number() over (partition by d.source order by d.size desc, d.doc_id nulls last) - 1 as k
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (floor(u + ratio * (k + 1)::double)::bigint - floor(u + ratio * k::double)::bigint) * size as taken from r""",
    "op6_ngram_join": f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) end) as s from w),
n as (select doc_id, count(*)::bigint as n from s group by doc_id),
hit as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
link as (select hit.a, hit.b from hit join n x on x.doc_id = hit.a join n y on y.doc_id = hit.b where 100 * o >= 75 * (x.n + y.n - o)),
reach as (select doc_id as a, doc_id as b from w union select reach.a, link.b from reach join link on link.a = reach.b)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id
from w left join n on n.doc_id = w.doc_id join (select a, min(b) as component_id from reach group by a) c on c.a = w.doc_id""",
}
