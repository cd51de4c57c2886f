"""The registered queries of this subpackage, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import alignment, classifier, forest, hamming, jaccard, mixing, passages, pieces, preference, quality, token_store, vector_codes, warc
from quire.llm.store import read_table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_risk_rules(spark: SparkSession, root: str) -> DataFrame:
    return quality.judge(read_table(spark, root, "documents"), read_table(spark, root, "labels"))


def op2_piece_round_trip(spark: SparkSession, root: str) -> DataFrame:
    return pieces.round_trip_digests(read_table(spark, root, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_jaccard_groups(spark: SparkSession, root: str) -> DataFrame:
    return jaccard.jaccard_groups(read_table(spark, root, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_prefix_forest(spark: SparkSession, root: str) -> DataFrame:
    vectors = read_table(spark, root, "embeddings")
    return forest.search(vectors, vectors.where("vec_id % 20 = 0"))


def op5_token_store(spark: SparkSession, root: str) -> DataFrame:
    return token_store.token_store(read_table(spark, root, "documents"), tokenizer("word_bpe_49k.json"))


def op6_repeated_passages(spark: SparkSession, root: str) -> DataFrame:
    found = passages.remove_passages(read_table(spark, root, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_units", "removed_words", "removed", "text")


def op7_source_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(read_table(spark, root, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_warc_archives(spark: SparkSession, root: str) -> DataFrame:
    return warc.archive_pages(read_table(spark, root, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_preference_pairs(spark: SparkSession, root: str) -> DataFrame:
    found = preference.preference_examples(read_table(spark, root, "conversations"))
    texts = [preference.joined(F.col(c), own).alias(c + "_trained" * own) for c in ("chosen", "rejected") for own in (False, True)]
    return found.select("conv_id", "n_prompt_turns", "prompt", *texts)


def op10_quality_scores(spark: SparkSession, root: str) -> DataFrame:
    return classifier.score_documents(read_table(spark, root, "documents"), read_table(spark, root, "labels"))


def op11_vector_codes(spark: SparkSession, root: str) -> DataFrame:
    return vector_codes.coded_vectors(read_table(spark, root, "embeddings"))


def op12_hamming_groups(spark: SparkSession, root: str) -> DataFrame:
    return hamming.near_duplicates(read_table(spark, root, "documents"))


def op13_token_alignment(spark: SparkSession, root: str) -> DataFrame:
    return alignment.alignment_digests(read_table(spark, root, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_risk_rules, op2_piece_round_trip, op3_jaccard_groups, op4_prefix_forest, op5_token_store, op6_repeated_passages, op7_source_mix, op8_warc_archives,
    op9_preference_pairs, op10_quality_scores, op11_vector_codes, op12_hamming_groups, op13_token_alignment,
)}

#: Rows of groups by shared 5-word shingles, linked when 100 * intersection >= {limit} * union.
_GROUPS = r"""
        with recursive w as (
          select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
        ), s as (
          select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                 else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w
        ), e as (select doc_id, len(s) as n, unnest(s) as g from s),
        o as (
          select a.doc_id as x, b.doc_id as y from e a join e b on a.g = b.g and a.doc_id < b.doc_id
          group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= {limit} * (a.n + b.n - count(*))
        ), l as (select x, y from o union all select y, x from o),
        r(a, b) as (select doc_id, doc_id from documents union select r.a, l.y from r join l on r.b = l.x),
        g as (select doc_id, cast(len(s) as bigint) as n_shingles, (select min(b) from r where r.a = s.doc_id) as component_id from s)
"""



def _codes_sql(rounds: int) -> str:
    """Vector codes: each round assigns by least (distance, entry) and moves entries to the floor of their means."""
    steps = [r"""
        v as (
          select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as x
          from embeddings where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), p as (
          select r, k as part, x[k * (len(x) // 4) + 1 : (k + 1) * (len(x) // 4)] as x, rank
          from (select *, row_number() over (order by vec_id) as rank from v), range(4) t(k)
        ), b0 as (select part, rank - 1 as entry, x from p where rank <= 256)"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} as (
          select r, p.part, min({{'d': list_inner_product(cast(p.x as double[]), cast(p.x as double[])) - 2 * list_inner_product(cast(p.x as double[]), cast(b.x as double[]))
                 + list_inner_product(cast(b.x as double[]), cast(b.x as double[])), 'e': entry}}) as m from p join b{k} b on p.part = b.part group by r, p.part
        )""")
        if k < rounds:
            steps.append(f"""s{k} as (
              select part, m.e as entry, i, sum(x[i + 1]) as s, count(*) as n from a{k} join p using (r, part), range(16) t(i) where i < len(x) group by all
            ), m{k} as (select part, entry, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as x from s{k} group by all),
            b{k + 1} as (select b.part, b.entry, coalesce(m.x, b.x) as x from b{k} b left join m{k} m on b.part = m.part and b.entry = m.entry)""")
    steps.append(f"""c as (
          select r, string_agg(lower(printf('%02x', m.e)), '' order by part) as code, cast(sum(m.d) as bigint) as error from a{rounds} group by r
        )""")
    return "with " + ", ".join(steps) + f"""
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
               (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) from b{rounds}) as codebooks_sha256 from c join v using (r)"""


CHECKS: dict[str, str] = {
    "op3_jaccard_groups": _GROUPS.format(limit=80) + "select * from g",
    "op11_vector_codes": _codes_sql(4),
    "op12_hamming_groups": _GROUPS.format(limit=85) + "select *, doc_id = component_id as kept from g",
    "op8_warc_archives": """
        with p as (
          select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
        ), g as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
        select page_id, payload_bytes, p.payload_digest,
               case when page_id <> first then 'revisit' else 'response' end as record_type,
               case when page_id <> first then first end as refers_to
        from p left join g using (payload_digest)""",
    "op9_preference_pairs": """
        with t as (
          select conv_id, list({'role': coalesce(role, 'user'), 'text': coalesce(text, '')} order by turn nulls first, role, text) as c
          from conversations group by conv_id
        ), p as (select *, list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant') as a from t),
        r as (
          select conv_id, c, case when len(a) > 0 then a[-1] else 0 end as last,
                 case when len(a) > 1 then c[a[-2]].text else '' end as earlier from p
        ), w as (
          select *, case when last > 0 and c[last].text <> earlier then last - 1 else len(c) end as n,
                 list_transform(range(1, len(c) + 1), lambda i: '<|im_start|>' || replace(c[i].role, '<|', '< |') || chr(10)) as h,
                 list_transform(range(1, len(c) + 1), lambda i: replace(c[i].text, '<|', '< |') || '<|im_end|>' || chr(10)) as g,
                 list_transform(range(1, len(c) + 1), lambda i: replace(case when i = last then earlier else c[i].text end, '<|', '< |')
                                || '<|im_end|>' || chr(10)) as b from r
        )
        select conv_id, n as n_prompt_turns,
               coalesce(array_to_string(list_transform(range(1, n + 1), lambda i: h[i] || g[i]), ''), '') as prompt,
               coalesce(array_to_string(list_transform(range(n + 1, len(c) + 1), lambda i: h[i] || g[i]), ''), '') as chosen,
               coalesce(array_to_string(list_transform(range(n + 1, len(c) + 1), lambda i: h[i] || b[i]), ''), '') as rejected,
               coalesce(array_to_string(list_transform(list_filter(range(n + 1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i: g[i]), ''), '') as chosen_trained,
               coalesce(array_to_string(list_transform(list_filter(range(n + 1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i: b[i]), ''), '') as rejected_trained
        from w""",
}
