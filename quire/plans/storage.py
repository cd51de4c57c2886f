"""Queries that write and read tables: persisted documents, index maintenance, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import schemas
from quire.plans import derived
from quire.plans import derived_sql as S
from quire.plans.extraction import CITE_VIEWS
from quire.plans.registry import register
from quire.plans.retrieval import ALL_CHUNK_VIEWS, CHUNK_WEIGHTS, VECTORS, _vector_index
from quire.session import scratch_path
from quire.sources import documents as D
from quire.sources import index as ix
from quire.sources.tables import table
from quire.streaming import ingest


def nested_documents(spark, root):
    """Every document as one nested record; elements are built inside the row."""
    split = F.split("text", "\n")
    box = "cast(named_struct('x0', 0.1, 'y0', cast(2 + i % 8 * 12 as double) / 100, 'x1', 0.9, 'y1', cast(9 + i % 8 * 12 as double) / 100, 'page', i div 8 + 1) as {})".format(schemas.BOX)
    element = f"""transform(split(text, '\\n'), (line, i) -> named_struct('id', concat(doc_id, ':', i),
      'element_type', case when i = 0 then 'title' when i % 7 = 1 then 'heading' else 'paragraph' end, 'content', line, 'page_number', i div 8 + 1,
      'bounding_box', {box}, 'confidence', 1.0, 'level', 0, 'font_size', 10.0, 'font_name', 'Times', 'is_bold', false, 'is_italic', false,
      'reading_order', i % 8, 'metadata', map('lang', lang)))"""
    empty = {k: F.array().cast(f"array<{v}>").alias(k) for k, v in schemas.CHILDREN.items() if k != "elements"}
    return table(spark, root, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc_"), "doc_id", F.lit(".pdf")).alias("filename"),
        F.lit(None).cast("string").alias("file_path"), F.lit("digital").alias("pipeline_type"), F.lit("completed").alias("status"),
        F.from_json(F.to_json(F.struct(split[0].alias("title"), F.array("source").alias("authors"), F.ceil(F.size(split) / 8).alias("page_count"), F.col("lang").alias("language"))), schemas.METADATA).alias("metadata"),
        F.expr(element).cast(f"array<{schemas.ELEMENT}>").alias("elements"), *empty.values(),
        F.lit(None).cast(schemas.STATS).alias("stats"), F.lit(None).cast("string").alias("error_message"),
        F.lit("2024-01-01T00:00:00").alias("created_at"), F.lit("2024-01-01T00:00:00").alias("updated_at"),
    )


_DOCS = """select doc_id::varchar as id, concat('doc_',doc_id,'.pdf') as filename, 'completed' as status, string_split(text,chr(10))[1] as title, source as authors,
 ceil(len(string_split(text,chr(10)))/8)::int as page_count, len(string_split(text,chr(10))) as n_elements, len(text)-len(string_split(text,chr(10)))+1 as n_chars from documents"""


def _docs_view(docs):
    return docs.select(
        "id", "filename", "status", "metadata.title", F.array_join("metadata.authors", ",").alias("authors"), "metadata.page_count",
        F.size("elements").alias("n_elements"),
        F.aggregate("elements", F.lit(0), lambda n, e: n + F.length(e["content"])).alias("n_chars"),
    )


@register("read_processed_docs", _DOCS)
def read_processed_docs(spark, root):
    path = D.write_processed_docs(nested_documents(spark, root), scratch_path(spark, "docs-json"), "json")
    return _docs_view(D.read_processed_docs(spark, path, multi_line=False))


@register("write_processed_docs", _DOCS)
def write_processed_docs(spark, root):
    path = D.write_processed_docs(nested_documents(spark, root), scratch_path(spark, "docs-parquet"), "parquet")
    return _docs_view(spark.read.parquet(path))


@register("rewrite_processed_docs", f"""
 select id, filename, case when id::bigint%3=0 then 'failed' else status end as status, title, authors, page_count, n_elements, n_chars
 from ({_DOCS}) where id::bigint not in (select doc_id from labels where toxic=1)""")
def rewrite_processed_docs(spark, root):
    """Write all, write a third again, delete the toxic ones: nothing else may change."""
    docs = nested_documents(spark, root)
    path = D.write_processed_docs(docs, scratch_path(spark, "docs-json"), "json")
    D.write_processed_docs(docs.where("cast(id as bigint) % 3 = 0").withColumn("status", F.lit("failed")), path, "json")
    D.delete_processed_docs(spark, path, table(spark, root, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id")), "json")
    return _docs_view(D.read_processed_docs(spark, path, multi_line=False))


@register("explode_children", S.query(S.LINES, select="""
 select doc_id::varchar as doc_id, pos, concat(doc_id,':',pos) as id, case when pos=0 then 'title' when pos%7=1 then 'heading' else 'paragraph' end as element_type,
  line as content, pos//8+1 as page_number, pos%8 as reading_order from lines"""))
def explode_children(spark, root):
    return D.explode_children(nested_documents(spark, root), "elements").select(
        "doc_id", "pos", "id", "element_type", "content", "page_number", "reading_order"
    )


_INDEX_ROWS = "select id as chunk_id, doc_id, chunk_type, round(list_sum(list_transform(e, lambda x: abs(x))),5) as l1 from"


def _index_view(df):
    return df.select("chunk_id", "doc_id", "chunk_type", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))), 5).alias("l1"))


@register("persist_index", S.query(VECTORS.split(",\n vqueries")[0], select=f"{_INDEX_ROWS} vindex"))
def persist_index(spark, root):
    path = ix.persist_index(_vector_index(spark, root), scratch_path(spark, "index"), partitioned=True)
    return _index_view(ix.load_index(spark, path))


_UPSERT = """fresh as (select id, doc_id, 'moved' as chunk_type, e from vindex where doc_id%2=0 union all
 select 'n'||id, doc_id, 'new', e from vindex where doc_id%2=1)"""


def _fresh(spark, root):
    old = _vector_index(spark, root)
    even = F.col("doc_id") % 2 == 0
    moved = old.where(even).withColumn("chunk_type", F.lit("moved"))
    new = old.where(~even).withColumn("chunk_id", F.concat(F.lit("n"), "chunk_id")).withColumn("chunk_type", F.lit("new"))
    unusable = old.withColumn("chunk_id", F.concat(F.lit("x"), "chunk_id")).withColumn("embedding", F.lit(None).cast("array<float>"))
    return moved.unionByName(new).unionByName(unusable)


@register("upsert_chunks", S.query(VECTORS.split(",\n vqueries")[0], _UPSERT, select=f"""
 {_INDEX_ROWS} (select id, doc_id, chunk_type, e from vindex where id not in (select id from fresh) union all select * from fresh)"""))
def upsert_chunks(spark, root):
    return _index_view(ix.upsert_chunks(_vector_index(spark, root), _fresh(spark, root)))


@register("upsert_chunks_append", S.query(VECTORS.split(",\n vqueries")[0], _UPSERT, select=f"""
 {_INDEX_ROWS} (select id, doc_id, chunk_type, e from vindex union all select * from fresh)"""))
def upsert_chunks_append(spark, root):
    return _index_view(ix.upsert_chunks(_vector_index(spark, root), _fresh(spark, root), append=True))


@register("delete_document", S.query(VECTORS.split(",\n vqueries")[0], select=f"{_INDEX_ROWS} vindex where doc_id not in (select doc_id from labels where toxic=1)"))
def delete_document(spark, root):
    toxic = table(spark, root, "labels").where("toxic = 1").select("doc_id")
    return _index_view(ix.delete_documents(_vector_index(spark, root), toxic))


@register("delete_stored", S.query(VECTORS.split(",\n vqueries")[0], select=f"""{_INDEX_ROWS}
 (select id, doc_id, case when doc_id%2=0 then 'moved' else chunk_type end as chunk_type, e from vindex) where doc_id not in (select doc_id from labels where toxic=1)"""))
def delete_stored(spark, root):
    """Store an index, merge half of its documents again, delete the toxic ones, and read what is left."""
    path = ix.persist_index(_vector_index(spark, root), scratch_path(spark, "index"), partitioned=True)
    ix.upsert_stored(spark, path, _vector_index(spark, root).where("doc_id % 2 = 0").withColumn("chunk_type", F.lit("moved")))
    ix.delete_stored(spark, path, table(spark, root, "labels").where("toxic = 1").select("doc_id"))
    return _index_view(ix.load_index(spark, path))


@register("chatml_dataset", """select conv_id, string_agg(concat('<|im_start|>',role,chr(10),text,'<|im_end|>'), chr(10) order by turn, role, text) as text from conversations group by conv_id""")
def chatml_dataset(spark, root):
    return D.chatml_conversations(table(spark, root, "conversations"))


_TEMPLATES = [{"title": f"T{i}", "abstract": f"Abstract {i}.", "review": f"Review {i}."} for i in range(3)]


@register("chatml_templates", """select item_id, concat('<|im_start|>system',chr(10),'You review papers.<|im_end|>',chr(10),'<|im_start|>user',chr(10),'Review this.',chr(10)||chr(10),
 'Title: T',item_id%3,' (Sample #',item_id+1,')',chr(10)||chr(10),'Abstract: Abstract ',item_id%3,'.<|im_end|>',chr(10),'<|im_start|>assistant',chr(10),'Review ',item_id%3,'.<|im_end|>') as text from benchmark""")
def chatml_templates(spark, root):
    return D.chatml_rows(table(spark, root, "benchmark"), _TEMPLATES, "item_id", "You review papers.", "Review this.")


# --- ingestion -----------------------------------------------------------------------------------

#: The documents that are left: some are sent again without content.
_ARRIVED = "arrived as (select * from documents where not (doc_id%5<>0 and doc_id%11=4))"


def _arriving(*views):
    return (_ARRIVED, *[v.replace("from documents", "from arrived") for v in views])


def _parsed(documents):
    spark, documents = documents.sparkSession, documents.where("text is not null")
    return {"elements": derived.elements(spark, documents), "tables": derived.tables(spark, documents), "figures": derived.figures(spark, documents)}


def _ingested(spark, root):
    """An index of two unequal batches, the second one tried twice.

    The first batch holds drafts of some documents; the second brings their
    texts and the rest, and sends some documents again without a text (an empty one still has a bibliography).
    """
    base = scratch_path(spark, "stream")
    docs, n = table(spark, root, "documents").select("doc_id", "text", "lang", "source", "n_chars"), F.col("doc_id")
    draft, gone = n % 7 == 3, n % 11 == 4
    first = docs.where(n % 5 != 0).withColumn("text", F.when(draft, F.concat(F.lit("Draft\n"), "text", F.lit("\nlast words of the draft"))).otherwise(F.col("text")))
    second = docs.where((n % 5 == 0) | draft | gone).withColumn("text", F.when((n % 5 != 0) & gone, F.lit(None)).otherwise(F.col("text")))
    for part in (first, second):
        part.write.mode("append").parquet(f"{base}/arriving")
        ingest.stream_ingest(spark, f"{base}/arriving", f"{base}/index", f"{base}/checkpoint", _parsed).awaitTermination()
    ingest.ingest_batch(second, 1, f"{base}/index", _parsed)
    return f"{base}/index"


@register("stream_ingest", S.query(*_arriving(*ALL_CHUNK_VIEWS), *CHUNK_WEIGHTS, """vectors as (select chunk_id, count(*) as n_buckets, round(sum(weight),5) as total from cw group by chunk_id)""", select="""
 select chunk_id, doc_id, chunk_type, page_number, token_count, md5(content) as content_md5, coalesce(n_buckets,0) as n_buckets, coalesce(total,0.0::double) as total
 from all_chunks left join vectors using (chunk_id)""", recursive=True))
def stream_ingest(spark, root):
    weights = F.array_remove("embedding", 0.0)  # none is negative
    return ingest.current_index(spark, _ingested(spark, root)).select(
        "chunk_id", "doc_id", "chunk_type", "page_number", "token_count", F.md5("content").alias("content_md5"),
        F.size(weights).alias("n_buckets"), F.round(F.aggregate(weights, F.lit(0.0), lambda s, x: s + x), 5).alias("total"),
    )


@register("stream_citations", S.query(*_arriving(*CITE_VIEWS), select="select citation_id, doc_id, kind, cite_key, reference_id from linked"))
def stream_citations(spark, root):
    return ingest.current_citations(spark, _ingested(spark, root)).select("citation_id", "doc_id", "kind", "cite_key", "reference_id")
