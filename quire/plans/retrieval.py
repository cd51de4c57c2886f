"""Queries on vectors, search and question answering."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import fixed
from quire.functions import classify, ngrams
from quire.functions import vectors as V
from quire.operators import answers as A
from quire.operators import chunking, embedding, equations, layout, search
from quire.plans import derived
from quire.plans import derived_sql as S
from quire.plans.extraction import EQUATIONS, PAIRS, _FTYPE, _ordered_distinct
from quire.plans.registry import register
from quire.plans.structure import CHUNK_VIEWS
from quire.session import scratch_path, stored
from quire.sources import index as ix
from quire.sources.tables import table

# --- chunks of every kind --------------------------------------------------------------------

SPECIAL = f"""table_chunks as (
 select concat('table:',t.table_id) as chunk_id, t.doc_id, 'table' as chunk_type,
  case when length(p.caption)>0 then concat('Table Caption: ',p.caption) else concat('Table on page ',t.page_number,' with ',t."rows",' rows and ',t.cols,' columns.') end as content,
  t.page_number, null::varchar as section, 0 as section_level, t.x0, t.y0, t.x1, t.y1, t.table_id as element_ids, t.pos as first_pos, 0 as part,
  t."rows", t.cols, p.caption
 from tables t left join paired_tables p using (table_id)),
 figure_chunks as (
 select concat('figure:',f.figure_id) as chunk_id, f.doc_id, 'figure' as chunk_type,
  case when length(p.caption)>0 then concat('Figure Caption: ',p.caption) else concat('Figure on page ',f.page_number,' (',coalesce({_FTYPE},'image'),').') end as content,
  f.page_number, null::varchar as section, 0 as section_level, f.x0, f.y0, f.x1, f.y1, f.figure_id as element_ids, f.pos as first_pos, 0 as part,
  p.caption, {_FTYPE} as figure_type
 from figures f left join paired_figures p using (figure_id)),
 equation_chunks as (
 select concat('equation:',equation_id) as chunk_id, doc_id, 'equation' as chunk_type, concat('Equation: ',coalesce(nullif(latex,''),raw_text)) as content,
  page_number, null::varchar as section, 0 as section_level, x0, y0, x1, y1, equation_id as element_ids, pos as first_pos, source_order*4294967296+match_pos as part,
  raw_text, latex, is_inline, array_to_string({_ordered_distinct('vs')},'|') as variables
 from eqs),
 special as (select *, {S.tokens('content')} as token_count from (select * from table_chunks union all by name select * from figure_chunks union all by name select * from equation_chunks)),
 all_chunks as (select * from text_chunks union all by name select * from special)"""
ALL_CHUNK_VIEWS = (*CHUNK_VIEWS, S.CAPTIONED, S.FIGURES, S.TABLES, PAIRS, EQUATIONS, SPECIAL)


def special_chunk_frames(spark, elements):
    eqs = equations.extract_equations(elements).withColumn("explanation", F.lit(None).cast("string"))
    return (
        chunking.table_chunks(layout.pair_table_captions(derived.tables(spark, elements), elements)),
        chunking.figure_chunks(layout.pair_figure_captions(derived.figures(spark, elements), elements)),
        chunking.equation_chunks(eqs),
    )


def all_chunks(spark, root):
    elements = derived.stored_elements(spark, root)
    return chunking.union_entities(chunking.pack_chunks(elements), *special_chunk_frames(spark, elements))


def stored_chunks(spark, root, whole=False):
    """Chunks as a table with their counts: weighting reads them twice (frequencies, then vectors) and must not chunk or count twice."""
    return stored(embedding.with_counts(all_chunks(spark, root), "content", whole=whole), "chunks")


def _flat(df):
    fields = [F.array_join("metadata.variables", "|").alias(f) if f == "variables" else F.col(f"metadata.{f}") for f in chunking.METADATA if f != "image_path"]
    return df.withColumn("element_ids", F.array_join("element_ids", "|")).select(*[c for c in df.columns if c != "metadata"], *fields)


@register("special_chunks", S.query(*S.ENTITY_VIEWS, PAIRS, EQUATIONS, SPECIAL.split(",\n all_chunks as")[0], select="select * from special"))
def special_chunks(spark, root):
    return _flat(chunking.union_entities(*special_chunk_frames(spark, derived.stored_elements(spark, root))))


@register("union_entities", S.query(*ALL_CHUNK_VIEWS, select="select * from all_chunks", recursive=True))
def union_entities(spark, root):
    return _flat(all_chunks(spark, root))


@register("order_chunks", S.query(*ALL_CHUNK_VIEWS, select="""
 select chunk_id, doc_id, chunk_type, page_number, row_number() over (partition by doc_id order by page_number, coalesce(y0,0),
  case chunk_type when 'table' then 0 when 'figure' then 1 when 'equation' then 2 else 3 end, first_pos, part) as place from all_chunks""", recursive=True))
def order_chunks(spark, root):
    return chunking.order_chunks(all_chunks(spark, root)).select("chunk_id", "doc_id", "chunk_type", "page_number", "place")


# --- vectors -------------------------------------------------------------------------------------

def _counts(name, source, key, text):
    pairs = f"list_transform(range(1,len(h)), lambda i: (h[i]*{ngrams.PAIR_FACTOR}+h[i+1]) % {fixed.EMBEDDING_DIM})"
    return f"""{name} as (select {key}, bucket, count(*) as cnt from (
      select {key}, unnest(list_concat(list_transform(h, lambda x: x % {fixed.EMBEDDING_DIM}), {pairs})) as bucket from (
       select {key}, list_transform(regexp_extract_all(lower({text}), '{fixed.WORD}'), lambda x: ('0x'||substr(md5(x),1,8))::bigint) as h from {source})) group by all)"""


def _whole_counts(name, source, key, text):
    """Every pair hashed as a term of its own."""
    return f"""{name} as (select {key}, ('0x'||substr(md5(term),1,8))::bigint % {fixed.EMBEDDING_DIM} as bucket, count(*) as cnt from (
      select {key}, unnest(list_concat(w, list_transform(range(1,len(w)), lambda i: w[i]||' '||w[i+1]))) as term from (
       select {key}, regexp_extract_all(lower({text}), '{fixed.WORD}') as w from {source})) group by all)"""


def _weights(name, counts, source, key):
    return f"""{name}_raw as (select c.{key}, c.bucket, c.cnt*(ln((1+n.n)/(1+d.df))+1) as raw from {counts} c
      join (select bucket, count(*) as df from {counts} group by bucket) d using (bucket), (select count(*)::double as n from {source}) n),
     {name} as (select {key}, bucket, raw/sqrt(sum(raw*raw) over (partition by {key})) as weight from {name}_raw)"""


def _unit_counts(name, counts, key):
    return f"{name} as (select {key}, bucket, cnt/sqrt(sum(cnt*cnt) over (partition by {key})) as weight from {counts})"


@register("hash_ngrams", S.query(_whole_counts("counts", "documents", "doc_id", "text"), select='select doc_id, bucket, cnt as "count" from counts'))
def hash_ngrams(spark, root):
    return embedding.hash_ngrams(table(spark, root, "documents"), "doc_id", "text", whole=True)


@register("tfidf", S.query(_counts("counts", "documents", "doc_id", "text"), _weights("w", "counts", "documents", "doc_id"),
                           select="select doc_id, bucket, round(weight,6) as weight from w"))
def tfidf(spark, root):
    return embedding.tfidf(table(spark, root, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


@register("embed_query", S.query(S.QUESTIONS, _whole_counts("counts", "questions", "query_id", "query"), _unit_counts("w", "counts", "query_id"),
                                 select="select query_id, bucket, round(weight,6) as weight from w"))
def embed_query(spark, root):
    vectors = embedding.embed_queries(derived.questions(spark, root), whole=True)
    return vectors.select("query_id", F.posexplode_outer("embedding").alias("bucket", "weight")).where("weight > 0").withColumn(
        "weight", F.round("weight", 6)
    )


@register("l2_normalize", """select vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::double)))
  / sqrt(list_sum(list_transform(embedding, lambda x: x::double*x::double))), 6) as l1_of_unit, true as is_unit from embeddings""")
def l2_normalize(spark, root):
    v = F.col("embedding")
    return embedding.l2_normalize(table(spark, root, "embeddings")).select(
        "vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("l1_of_unit"),
        (F.abs(V.norm(v) - 1) < 1e-9).alias("is_unit"),
    )


CHUNK_WEIGHTS = (_counts("ccounts", "all_chunks", "chunk_id", "content"), _weights("cw", "ccounts", "all_chunks", "chunk_id"))


@register("embed_chunks", S.query(*ALL_CHUNK_VIEWS, _whole_counts("ccounts", "all_chunks", "chunk_id", "content"), CHUNK_WEIGHTS[1], select="""
 select c.chunk_id, count(w.bucket) as n_buckets, coalesce(round(sum(w.weight),5),0.0::double) as total
 from all_chunks c left join cw w using (chunk_id) group by c.chunk_id""", recursive=True))
def embed_chunks(spark, root):
    weights = F.array_remove("embedding", 0.0)  # none is negative
    return (
        chunk_vectors(spark, root, whole=True)
        .select("chunk_id", F.size(weights).alias("n_buckets"), F.round(F.aggregate(weights, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))
    )


# --- vector search over the embeddings table ------------------------------------------------

def _vector_index(spark, root):
    """Every vector as a chunk; its label serves as document and as chunk type."""
    return table(spark, root, "embeddings").select(
        F.format_string("v%08d", "vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("doc_id"),
        F.concat(F.lit("type"), F.col("label") % 3).alias("chunk_type"), "embedding",
    )


def _vector_queries(spark, root):
    """The first vector of every label asks for its neighbours."""
    return table(spark, root, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(
        F.col("label").cast("bigint").alias("query_id"), "embedding"
    )


VECTORS = """vindex as (
 select 'v'||lpad(vec_id::varchar,8,'0') as id, label::bigint as doc_id, 'type'||(label%3) as chunk_type, embedding::double[] as e from embeddings),
 vqueries as (select label::bigint as query_id, arg_min(embedding::double[], vec_id) as q from embeddings group by label),
 scored as (
 select q.query_id, v.id, v.doc_id, v.chunk_type,
  round(list_dot_product(q.q, v.e)/sqrt(list_dot_product(q.q,q.q))/sqrt(list_dot_product(v.e,v.e)),12)+0.0::double as score
 from vqueries q, vindex v)"""


def _top(k, source="scored", digits=6):
    return f"""select query_id, id, round(score,{digits}) as score, row_number() over (partition by query_id order by score desc, id) as rank from {source}
     qualify row_number() over (partition by query_id order by score desc, id)<={k}"""


def _shown(hits):
    """Scores as the checks compare them; ranking used the full ones."""
    return hits.withColumn("score", F.round("score", 6) + 0.0)


@register("knn_topk", S.query(VECTORS, select=_top(10)))
def knn_topk(spark, root):
    return _shown(search.knn_topk(_vector_queries(spark, root), _vector_index(spark, root), 10))


@register("knn_by_type", S.query(VECTORS, select=_top(3, "(select * from scored where chunk_type='type1')")))
def knn_by_type(spark, root):
    return _shown(search.knn_by_type(_vector_queries(spark, root), _vector_index(spark, root), "type1", 3))


@register("knn_by_type_oversampled", S.query(VECTORS, f"wide as ({_top(15, digits=12)})", select=_top(
    3, "(select w.query_id, w.id, w.score from wide w join vindex v using (id) where v.chunk_type='type1')")))
def knn_by_type_oversampled(spark, root):
    return search.knn_by_type(_vector_queries(spark, root), _vector_index(spark, root), "type1", 3, oversample=True).transform(_shown)


def _wanted_documents(spark, root):
    """Labels whose average first component is positive: a document list computed from the data."""
    return table(spark, root, "embeddings").groupBy(F.col("label").cast("bigint").alias("doc_id")).agg(
        F.avg(F.col("embedding")[0].cast("double")).alias("m")
    ).where("m > 0")


WANTED = "wanted as (select label::bigint as doc_id from embeddings group by label having avg(embedding[1]::double)>0)"


@register("knn_postfilter", S.query(VECTORS, WANTED, select=_top(10, "(select * from scored where doc_id in (select doc_id from wanted))")))
def knn_postfilter(spark, root):
    return search.knn_postfilter(_vector_queries(spark, root), _vector_index(spark, root), _wanted_documents(spark, root), 10).transform(_shown)


@register("knn_postfilter_oversampled", S.query(VECTORS, WANTED, f"wide as ({_top(50, digits=12)})", select=_top(
    10, "(select w.query_id, w.id, w.score from wide w join vindex v using (id) where v.doc_id in (select doc_id from wanted))")))
def knn_postfilter_oversampled(spark, root):
    return search.knn_postfilter(
        _vector_queries(spark, root), _vector_index(spark, root), _wanted_documents(spark, root), 10, mode="oversample"
    ).transform(_shown)


@register("knn_in_scope", S.query(VECTORS, select=_top(5, "(select * from scored where doc_id=query_id)")))
def knn_in_scope(spark, root):
    queries = _vector_queries(spark, root)
    return search.knn_in_scope(queries, _vector_index(spark, root), queries.select("query_id", F.col("query_id").alias("doc_id")), 5).transform(_shown)


@register("doc_ids_filter", S.query(VECTORS, WANTED, select="""
 select id as chunk_id, doc_id, chunk_type from vindex where doc_id in (select doc_id from wanted)"""))
def doc_ids_filter(spark, root):
    return search.restrict_documents(_vector_index(spark, root), _wanted_documents(spark, root)).drop("embedding")


# --- questions ---------------------------------------------------------------------------------

_INTENT = """case
 when regexp_matches(lower({q}),'summarize|summary|overview|tldr|tl;dr|abstract|brief') then 'summary'
 when regexp_matches(lower({q}),'table|tabular|row|column|cell|dataset|benchmark') then 'table'
 when regexp_matches(lower({q}),'figure|diagram|image|plot|graph|chart|illustration|architecture') then 'figure'
 when regexp_matches(lower({q}),'equation|formula|loss function|math|expression|gradient|latex') then 'equation'
 when regexp_matches(lower({q}),'cite|citation|reference|bibliography|doi|who wrote') then 'citation'
 when regexp_matches(lower({q}),'compare|comparison|related work|state of the art|contribution|novelty|limitation') then 'research'
 else 'qa' end"""
_TEXTS = """texts as (select item_id+1000000 as query_id, text as query from benchmark
 union all select conv_id*1000+turn, text from conversations union all select query_id-1, query from questions)"""


def _texts(spark, root):
    return (
        table(spark, root, "benchmark").select((F.col("item_id") + 1000000).alias("query_id"), F.col("text").alias("query"))
        .unionByName(table(spark, root, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query")))
        .unionByName(derived.questions(spark, root).select((F.col("query_id") - 1).alias("query_id"), "query"))
    )


@register("classify_intent", S.query(S.QUESTIONS, _TEXTS, select=f"select query_id, query, {_INTENT.replace('{q}', 'query')} as intent from texts"))
def classify_intent(spark, root):
    return _texts(spark, root).withColumn("intent", classify.intent(F.col("query")))




_STOPS = fixed.QUESTION_STOP_WORDS.rpartition("(")[2].partition(")")[0]
CLEANED = f"""spread as (
  select query_id, regexp_replace(query, '([^a-zA-Z0-9_\\x{{AA}}-\\x{{24F}}])', chr(1)||'\\1'||chr(1), 'g') as s from questions),
 cut as (select query_id, regexp_replace(chr(1)||s||chr(1), '(?i)'||chr(1)||'({_STOPS})'||chr(1), chr(1)||' '||chr(1), 'g') as s from spread),
 cleaned_questions as (select query_id, {S.strip('replace(s,chr(1),' + chr(39) * 2 + ')')} as cleaned from cut)"""


@register("clean_query", S.query(S.QUESTIONS, CLEANED, select="select query_id, cleaned from cleaned_questions"))
def clean_query(spark, root):
    return derived.questions(spark, root).select("query_id", classify.clean_query(F.col("query")).alias("cleaned"))


@register("valid_queries", S.query(S.QUESTIONS, """asked as (
  select query_id, case when query_id%7=3 then '  '||chr(9) else query end as query, (query_id*5)%60 as k from questions)""",
 select=f"select query_id, k from asked where length({S.strip('query')})>0 and k between 1 and 50"))
def valid_queries(spark, root):
    q = F.col("query_id")
    asked = derived.questions(spark, root).select(
        "query_id", F.when(q % 7 == 3, F.lit("  \t")).otherwise(F.col("query")).alias("query"), ((q * 5) % 60).alias("k")
    )
    return search.valid_queries(asked).select("query_id", "k")


@register("augment_query", S.query(S.QUESTIONS, f"i as (select query_id, query, {_INTENT.replace('{q}', 'query')} as intent from questions)", select="""
 select query_id, intent, case when intent='citation' then 'citations references bibliography '||query else query end as augmented from i"""))
def augment_query(spark, root):
    asked = derived.questions(spark, root).withColumn("intent", classify.intent(F.col("query")))
    return asked.select("query_id", "intent", classify.augment_query(F.col("query"), F.col("intent")).alias("augmented"))


# --- search over chunks --------------------------------------------------------------------------

def chunk_vectors(spark, root, whole=False):
    return embedding.embed_chunks(stored_chunks(spark, root, whole), whole=whole).drop("buckets", "counts")


def chunk_index(spark, root):
    """The corpus index as a table in the shared folder, so that searches scan it and never rebuild it."""
    path = ix.persist_index(chunk_vectors(spark, root), scratch_path(spark, "index"))
    return ix.load_index(spark, path)


_PLAN = f"""planned as (
 select query_id, intent, case when intent='citation' then 'citations references bibliography '||query else query end as query,
  case intent when 'table' then 3 when 'figure' then 3 when 'equation' then 3 when 'citation' then 6 when 'research' then 8 else 5 end as k,
  case when intent in ('table','figure','equation') then intent end as first_type
 from (select query_id, query, {_INTENT.replace('{q}', 'query')} as intent from questions))"""
_HITS = (*ALL_CHUNK_VIEWS, *CHUNK_WEIGHTS, S.QUESTIONS, _PLAN, _counts("qcounts", "planned", "query_id", "query"), _unit_counts("qw", "qcounts", "query_id"),
         """dots as (
 select q.query_id, c.chunk_id as id, sum(q.weight*c.weight) as s from qw q join cw c using (bucket) group by all),
 pairs as (
 select p.query_id, p.intent, p.k, c.chunk_id as id, coalesce(round(d.s,12),0.0::double) as score
 from planned p join all_chunks c on (p.first_type is null or c.chunk_type=p.first_type)
 left join dots d on d.query_id=p.query_id and d.id=c.chunk_id),
 hits as (
 select query_id, intent, id, score, row_number() over (partition by query_id order by score desc, id) as rank from pairs
 qualify row_number() over (partition by query_id order by score desc, id)<=k)""")


def _plan_hits(spark, root):
    index = chunk_index(spark, root)
    return search.retrieval_plan(derived.questions(spark, root), index), index


@register("retrieval_plan", S.query(*_HITS, select="select query_id, intent, id, round(score,6) as score, rank from hits", recursive=True))
def retrieval_plan(spark, root):
    return _shown(_plan_hits(spark, root)[0])


@register("format_context", S.query(*_HITS, select="""
 select h.query_id, string_agg(concat('[Source ',h.rank,'] Doc=',substr(c.doc_id::varchar,1,8),'… | Page=',c.page_number,' | Type=',c.chunk_type,
  case when length(c.section)>0 then concat(' | Section=',c.section) else '' end, chr(10), c.content), chr(10)||chr(10)||'---'||chr(10)||chr(10) order by h.rank) as context
 from hits h join all_chunks c on c.chunk_id=h.id group by h.query_id""", recursive=True))
def format_context(spark, root):
    hits, index = _plan_hits(spark, root)
    return search.format_context(hits, index)


@register("verify_sources", S.query(*_HITS, S.ANSWERS, r"""cited as (
  select query_id, list_distinct(list_transform(regexp_extract_all(answer,'(?i)\[Source\s*([0-9]+)\]',1), lambda x: x::int)) as c from answers)""", select="""
 select h.query_id, concat('Source ',h.rank) as source_id, c.doc_id, c.page_number, coalesce(c.section,'') as section, c.chunk_type,
  c.x0, c.y0, c.x1, c.y1, substr(c.content,1,200) as snippet
 from hits h join cited a using (query_id) join all_chunks c on c.chunk_id=h.id
 where list_contains(a.c, h.rank) or (len(a.c)=0 and (select count(*) from hits x where x.query_id=h.query_id)<=2)""", recursive=True))
def verify_sources(spark, root):
    hits, index = _plan_hits(spark, root)
    return search.verify_sources(derived.answers(spark, root), hits, index)


#: The documents a question names: those of some sources, told by a digit of the source's hash; every fifth question names none.
_SCOPE = """scope as (select q.query_id, d.doc_id from questions q join documents d
  on q.query_id%5<>0 and q.query_id%4=(('0x'||substr(md5(d.source),1,1))::int%4) and d.lang=['de','es','fr'][q.query_id%3+1])"""


def _attempt(i, asked, k=5):
    return (f"asked{i} as ({asked})", _counts(f"qcounts{i}", f"asked{i}", "query_id", "query"), _unit_counts(f"qw{i}", f"qcounts{i}", "query_id"), f"""dots{i} as (
 select q.query_id, c.chunk_id as id, sum(q.weight*c.weight) as s from qw{i} q join cw c using (bucket) group by all),
 wide{i} as (
 select a.query_id, c.chunk_id as id, c.doc_id, coalesce(round(d.s,12),0.0::double) as score,
  row_number() over (partition by a.query_id order by coalesce(round(d.s,12),0.0::double) desc, c.chunk_id) as place
 from asked{i} a cross join all_chunks c left join dots{i} d on d.query_id=a.query_id and d.id=c.chunk_id
 qualify place<={5 * k}),
 hits{i} as (
 select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank, {i} as attempt from wide{i} w
 where case when query_id in (select query_id from scope) then exists (select 1 from scope s where s.query_id=w.query_id and s.doc_id=w.doc_id) else place<={k} end
 qualify rank<={k})""")


_FALLBACK = (*ALL_CHUNK_VIEWS, *CHUNK_WEIGHTS, S.QUESTIONS, CLEANED, _SCOPE, *_attempt(1, "select * from questions"),
             *_attempt(2, "select query_id, cleaned as query from cleaned_questions where length(cleaned)>=3 and query_id not in (select query_id from hits1)"),
             *_attempt(3, f"""select query_id, '{fixed.OVERVIEW_QUESTION}' as query from questions where query_id in (select query_id from scope)
  and query_id not in (select query_id from hits1) and query_id not in (select query_id from hits2)"""))


def _scope(spark, root):
    digit = F.conv(F.substring(F.md5(F.col("source").cast("binary")), 1, 1), 16, 10).cast("int") % 4
    docs = table(spark, root, "documents").select("doc_id", "lang", digit.alias("digit"))
    q = F.col("query_id")
    asked = derived.questions(spark, root).where(q % 5 != 0).select("query_id", (q % 4).cast("int").alias("digit"), F.element_at(F.array(*map(F.lit, ("de", "es", "fr"))), (q % 3 + 1).cast("int")).alias("lang"))
    return asked.join(docs, ["digit", "lang"]).select("query_id", "doc_id")


@register("search_fallback", S.query(*_FALLBACK, select="""
 select query_id, id, round(score,6) as score, rank, attempt from (select * from hits1 union all select * from hits2 union all select * from hits3)""", recursive=True))
def search_fallback(spark, root):
    """All documents, an own scope for four questions of five; those that find nothing are asked again."""
    chunks = stored_chunks(spark, root)
    idf = embedding.inverse_frequencies(embedding.bucket_frequencies(chunks))
    return _shown(search.search_fallback(derived.questions(spark, root), chunks, 5, _scope(spark, root), mode="oversample", idf=idf))


@register("extract_json_object", S.query(S.ANSWERS, r"""j as (
  select query_id, regexp_extract(reply,'(?s)\{.*\}',0) as body from answers)""", select="""
 select query_id, case when json_valid(body) and body<>'' then json_extract_string(body,'$.overall_decision') end as overall_decision,
  case when json_valid(body) and body<>'' then json_extract_string(body,'$.soundness_score')::double end as soundness_score,
  body<>'' and json_valid(body) as parsed from j"""))
def extract_json_object(spark, root):
    return A.parse_reviews(derived.answers(spark, root), "reply").select(
        "query_id", "review.overall_decision", "review.soundness_score", "parsed"
    )
