"""Queries of this subpackage and their SQL, as ``__spark_entry__`` adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelens.llm import language, sentencepiece_dropout, toxicity
from pipelens.llm.common import held_out, table
from pipelens.llm.embedding_dedup import near_vectors
from pipelens.llm.html_text import extract_text
from pipelens.llm.line_dedup import dedup_lines
from pipelens.llm.minhash import near_duplicates
from pipelens.llm.packing import pack_documents
from pipelens.llm.topk import top_k
from pipelens.llm.url_filter import filter_urls
from pipelens.llm.vectors import usable

#: Fixed values of the query's contract.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids under dropout, by a digest, and whether they decode to the text."""
    file = tokenizer_file("piece_bpe_32k.model")
    ids = sentencepiece_dropout.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), file, seed=1, dropout=0.1)
    out = sentencepiece_dropout.decode(ids, file)
    return out.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"),
        F.crc32(F.array_join("ids", " ").cast("binary")).alias("ids_crc32"),
        F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"),
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("ok", usable("embedding"))
    whole = F.when(F.col("ok"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 64)))
    found = top_k(rows.select("vec_id", whole.alias("vector")), F.pmod("vec_id", F.lit(20)) == 0, k=20)
    return found.select("query_id", "rank", "vec_id", "score")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "n_removed")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


OP5_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(embedding) > 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 20
"""


OP8_SQL = r"""
with p as (
  select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), h as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p
), rules(h, p, v) as (
  values %s
), hits as (
  select h.host, h.path, max({'n': length(r.h || r.p), 'rule': r.h || r.p, 'verdict': r.v}) as best
  from (select distinct host, path from h) h join rules r
    on (h.host = r.h or ends_with(h.host, '.' || r.h)) and starts_with(h.path, r.p)
  group by all
)
select page_id, h.host, h.path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict
from h left join hits on h.host = hits.host and h.path = hits.path
""" % ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


REACH = """, reach(a, b) as (
  select u, u from links union select r.a, l.v from reach r join links l on r.b = l.u
), components as (select a as id, min(b) as component_id from reach group by a)"""

#: Word sets are joined on their shingles, so that all pairs that share one are counted.
OP4_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w
), t as (
  select doc_id, len(s) as n, unnest(s) as t from s
), shared as (
  select a.doc_id as u, b.doc_id as v, a.n as nu, b.n as nv, count(*) as c from t a join t b on a.t = b.t and a.doc_id <> b.doc_id group by all
), links as (
  select u, v from shared where 100 * c >= 80 * (nu + nv - c)
)%s
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(c.component_id, s.doc_id) as component_id, coalesce(c.component_id, s.doc_id) = s.doc_id as kept
from s left join components c on c.id = s.doc_id
""" % REACH

OP10_SQL = """
with recursive e as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as u, b.vec_id as v from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.93
)%s
select m.vec_id, coalesce(l.n, 0)::bigint as n_links, coalesce(c.component_id, m.vec_id) as component_id, coalesce(c.component_id, m.vec_id) = m.vec_id as kept
from embeddings m left join (select u, count(*) as n from links group by u) l on l.u = m.vec_id left join components c on c.id = m.vec_id
""" % REACH


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_packing, op2_toxicity, op3_sentencepiece, op4_minhash, op5_topk, op6_html_text, op7_line_dedup, op8_url_filter, op9_language_id, op10_embedding_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash": OP4_SQL, "op5_topk": OP5_SQL, "op8_url_filter": OP8_SQL, "op10_embedding_dedup": OP10_SQL}
