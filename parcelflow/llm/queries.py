"""The dealt operators as registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, html_text, jaccard, packing, periodic, phrases, pii, quality, suffixes, toxicity, vafile, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query()
def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


@_query()
def op2_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


@_query()
def op3_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer())


@_query(
    """
    with p as (select page_id, coalesce(html, '') as h from pages),
    q as (select page_id, strlen(h) as n, sha1(h) as d, max(page_id) over (partition by h) as k from p)
    select page_id, n as payload_bytes, d as payload_digest,
        case when n >= 1000 and page_id <> k then 'revisit' else 'response' end as record_type,
        case when n >= 1000 and page_id <> k then k end as refers_to
    from q
    """
)
def op4_segment_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


@_query()
def op5_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


@_query()
def op6_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query()
def op7_token_group_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@_query()
def op8_deep_shallow_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


@_query()
def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query()
def op10_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


@_query(
    """
    with e as (
        select vec_id, [floor(256 * x::double) for x in embedding] as v
        from embeddings
        where embedding is not null and coalesce(list_bool_and([x is not null and isfinite(x) for x in embedding]), true)),
    s as (
        select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
        from e q join e c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v))
    select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
    from s qualify rank <= 5
    """
)
def op11_vector_approximation_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@_query()
def op12_recursive_frequency_splitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(periodic.with_periodic_tails(_table(spark, sf_dir, "documents")))


@_query(
    r"""
    with d as (
        select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
        from documents),
    w as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
    k as (select lang, term, count(*) as n from w group by lang, term having count(distinct r) >= 3),
    c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by all),
    v as (select lang, count(*) as v, sum(n) as total from k group by lang),
    g as (select distinct lang, source from d),
    t as (select lang, source, sum(n) as total from c group by all),
    s as (
        select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
            1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (coalesce(t.total, 0) + v.v) as p,
            1 + 1000000000::hugeint * (k.n + 1) // (v.total + v.v) as q
        from g join k using (lang) join v using (lang) left join t using (lang, source) left join c using (lang, source, term)),
    pairs as (
        select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
        from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    parts as (
        select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
        from g a join g b on a.lang = b.lang and a.source <> b.source
        left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
        union all
        select lang, source, 'term', term, (p - q) * (p - q) // q from s where n > 0 and p > q)
    select lang, source, part, item, value::bigint as value,
        row_number() over (partition by lang, source, part order by value desc, item)::int as rank
    from parts qualify part = 'pair' or rank <= 200
    """
)
def op13_pattern_tree_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))
