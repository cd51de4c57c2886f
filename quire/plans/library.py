"""Queries on recognised text, document lists, messages and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import classify
from quire.operators import answers as A
from quire.operators import catalog as C
from quire.operators import chunking, citations
from quire.operators import recognition as O
from quire.plans import derived
from quire.plans import derived_sql as S
from quire.plans.extraction import CITES, EQUATIONS, REFS, all_equations, all_references
from quire.plans.registry import register
from quire.plans.retrieval import ALL_CHUNK_VIEWS
from quire.plans.structure import CHUNK_VIEWS
from quire.session import stored
from quire.sources.tables import table


def _rounded(column):
    """Six digits, with exact halves nudged up so that both engines round them alike."""
    return F.round(F.col(column) + 1e-9, 6)


# --- recognised text -----------------------------------------------------------------------------

_FONTS = ["Times", "Helvetica-Bold", "Courier-Oblique", "Garamond"]
_SPANS = f"""spans as (select doc_id, page_number, line_num as block_num, 0 as line_num, word_num as span_num, text, 9.0::double+(word_num*line_num)%5*3 as size,
  {_FONTS!r}[((line_num+word_num//7)%4+1)::int] as font, case when line_num%6=5 then 16 when line_num%6=4 then 2 else 0 end as flags from words)"""


def _spans(spark, root):
    line, k = F.col("line_num"), F.col("word_num")
    return derived.words(spark, root).select(
        "doc_id", "page_number", line.alias("block_num"), F.lit(0).alias("line_num"), k.alias("span_num"), "text",
        (F.lit(9.0) + (k * line) % 5 * 3).alias("size"),
        F.element_at(F.array(*[F.lit(f) for f in _FONTS]), ((line + F.floor(k / 7)) % 4 + 1).cast("int")).alias("font"),
        F.when(line % 6 == 5, 16).when(line % 6 == 4, 2).otherwise(0).alias("flags"),
    )


BLOCKS = f"""kept as (select * from spans where length({S.strip('text')})>0),
 sizes as (select doc_id, block_num, size, row_number() over (partition by doc_id, block_num order by count(*) desc, size) as r from kept group by doc_id, block_num, size),
 fonts as (select doc_id, block_num, font, row_number() over (partition by doc_id, block_num order by count(*) desc, font) as r from kept group by doc_id, block_num, font),
 blocks as (
 select k.doc_id, k.page_number, k.block_num, {S.strip("string_agg(k.text,' ' order by k.span_num)")} as content, any_value(s.size) as font_size, any_value(f.font) as font_name,
  bool_or(k.flags=16) or bool_or(regexp_matches(lower(k.font),'bold|black|heavy')) as is_bold,
  bool_or(k.flags=2) or bool_or(regexp_matches(lower(k.font),'italic|oblique')) as is_italic
 from kept k join sizes s on s.doc_id=k.doc_id and s.block_num=k.block_num and s.r=1 join fonts f on f.doc_id=k.doc_id and f.block_num=k.block_num and f.r=1
 group by k.doc_id, k.page_number, k.block_num)"""


@register("spans_to_blocks", S.query(S.LINES, S.BODY, S.WORDS, _SPANS, BLOCKS, select="select * from blocks"))
def spans_to_blocks(spark, root):
    return O.spans_to_blocks(_spans(spark, root))


@register("classify_element", S.query(S.LINES, S.BODY, S.WORDS, _SPANS, BLOCKS, """ordered as (
  select *, row_number() over (partition by doc_id, page_number order by block_num)-1 as reading_order from blocks)""", select="""
 select doc_id, page_number, block_num, reading_order, case
  when font_size>18 and page_number=1 and reading_order<3 then 'title' when font_size>11.5 and is_bold and length(content)<120 then 'heading'
  when font_size>10 and is_bold and length(content)<80 then 'subheading' when page_number=1 and contains(substr(lower(content),1,40),'abstract') then 'abstract'
  when contains(lower(content),'references') and length(content)<50 then 'references' when length(content)<6 and regexp_matches(content,'^[0-9]+$') then 'page_number'
  else 'paragraph' end as element_type from ordered"""))
def classify_element(spark, root):
    return O.classify_blocks(O.spans_to_blocks(_spans(spark, root))).select("doc_id", "page_number", "block_num", "reading_order", "element_type")


_OCR_WORDS = ["Abstract", "1 Introduction", "Conclusion and", "References", "12345", ""]


@register("classify_ocr_line", S.query(*S.DOC_VIEWS, f"""l as (select doc_id, pos, concat({_OCR_WORDS!r}[pos%6+1], case when pos%6=4 then '' else content end) as t from elements)""", select="""
 select doc_id, pos, case when length(t)<80 and contains(lower(t),'references') then 'references' when length(t)<80 and contains(lower(t),'abstract') then 'abstract'
  when length(t)<80 and regexp_matches(lower(t),'introduction|conclusion') then 'heading' when length(t)<6 and regexp_matches(t,'^[0-9]+$') then 'page_number'
  else 'paragraph' end as line_type from l"""))
def classify_ocr_line(spark, root):
    pos = F.col("pos")
    word = F.element_at(F.array(*[F.lit(w) for w in _OCR_WORDS]), (pos % 6 + 1).cast("int"))
    text = F.concat(word, F.when(pos % 6 == 4, "").otherwise(F.col("content")))
    return derived.elements(spark, root).select("doc_id", "pos", classify.ocr_line_type(text).alias("line_type"))


_LINES_SQL = """usable as (select *, conf/100.0::double as c, greatest(0.0::double,"left"/612.0::double) as wx0, greatest(0.0::double,top/792.0::double) as wy0,
  least(1.0::double,("left"+width)/612.0::double) as wx1, least(1.0::double,(top+height)/792.0::double) as wy1 from words where length(trim(text))>0 and conf>=0),
 olines as (select doc_id, page_number, block_num, par_num, line_num, string_agg(trim(text),' ' order by wx0, word_num) as text, avg(c) as confidence, sum(conf) as conf_sum, count(*) as n_words,
  min(wx0) as x0, min(wy0) as y0, max(wx1) as x1, max(wy1) as y1 from usable group by doc_id, page_number, block_num, par_num, line_num)"""


@register("ocr_words_to_lines", S.query(S.LINES, S.BODY, S.WORDS, _LINES_SQL, select="select * replace (round(confidence+1e-9::double,6) as confidence) from olines"))
def ocr_words_to_lines(spark, root):
    return O.words_to_lines(derived.words(spark, root)).withColumn("confidence", _rounded("confidence"))


@register("ocr_page_confidence", S.query(S.LINES, S.BODY, S.WORDS, _LINES_SQL, select="""
 select p.doc_id, p.page_number, round(coalesce(avg(u.c),1.0::double)+1e-9::double,6) as mean_confidence, count(u.c) as n_words,
  (select string_agg(text, chr(10) order by line_num) from olines o where o.doc_id=p.doc_id and o.page_number=p.page_number) as full_text
 from (select distinct doc_id, page_number from words) p left join usable u using (doc_id, page_number) group by p.doc_id, p.page_number"""))
def ocr_page_confidence(spark, root):
    words = derived.words(spark, root)
    pages = O.page_confidence(words).withColumn("mean_confidence", _rounded("mean_confidence"))
    return pages.join(O.page_text(O.words_to_lines(words)), ["doc_id", "page_number"], "left")


@register("ocr_line_filter_and_word_boxes", S.query(S.LINES, S.BODY, S.WORDS, _LINES_SQL, f"""chosen as (
  select *, string_split_regex({S.strip('text')},'\\s+') as ws from olines where conf_sum>=70*n_words),
 spread as (select *, unnest(range(len(ws))) as word_num, unnest(ws) as word from chosen),
 placed as (select *, (x1-x0)/greatest(1,length(array_to_string(ws,' '))) as per_char,
   coalesce(sum(length(word)+1) over (partition by doc_id, line_num order by word_num rows between unbounded preceding and 1 preceding),0) as off from spread)""", select="""
 select doc_id, page_number, block_num, par_num, line_num, word_num, word as text, round(confidence+1e-9::double,6) as confidence, round(x0+off*per_char+1e-9::double,6) as wx0,
  round(least(x1, x0+off*per_char+length(word)*per_char)+1e-9::double,6) as wx1, y0, y1 from placed"""))
def ocr_line_filter_and_word_boxes(spark, root):
    words = O.line_words(O.words_to_lines(derived.words(spark, root)))
    return words.select(*O.LINE, "word_num", "text", _rounded("confidence").alias("confidence"), _rounded("wx0").alias("wx0"), _rounded("wx1").alias("wx1"), "y0", "y1")


@register("route_pipeline", S.query(*S.DOC_VIEWS, f"""pg as (select doc_id, page_number, sum(length({S.strip("content")}))+count(*)-1 as n from elements group by all)""", select="""
 select doc_id, round(avg(n)+1e-9::double,6) as avg_chars, avg(n)<100 as is_scanned, case when avg(n)<100 then 'scanned' else 'digital' end as pipeline_type from pg group by doc_id"""))
def route_pipeline(spark, root):
    pages = O.page_lengths(derived.elements(spark, root))
    return O.route_pipeline(pages, table(spark, root, "documents")).withColumn("avg_chars", _rounded("avg_chars"))


# --- grids ---------------------------------------------------------------------------------------

_GW = """gw as (select doc_id, page_number, word_num, text, "left"+(line_num*7)%20 as x0, top+(word_num*3)%4 as y0 from words where length(trim(text))>0)"""
_GRID = """ys as (select doc_id, page_number, y0, count(*) as n, row_number() over (partition by doc_id, page_number order by y0) as rn from gw group by doc_id, page_number, y0),
 yw(doc_id, page_number, rn, y0, total, n, row_idx) as (
  select doc_id, page_number, rn, y0, y0*n, n, 0 from ys where rn=1 union all
  select s.doc_id, s.page_number, s.rn, s.y0, case when abs(s.y0-w.total/w.n)<=5 then w.total+s.y0*s.n else s.y0*s.n end,
   case when abs(s.y0-w.total/w.n)<=5 then w.n+s.n else s.n end, case when abs(s.y0-w.total/w.n)<=5 then w.row_idx else w.row_idx+1 end
  from yw w join ys s on s.doc_id=w.doc_id and s.page_number=w.page_number and s.rn=w.rn+1),
 xs as (select doc_id, page_number, x0, row_number() over (partition by doc_id, page_number order by x0) as rn from (select distinct doc_id, page_number, x0 from gw)),
 xw(doc_id, page_number, rn, x0, anchor, col_idx) as (
  select doc_id, page_number, rn, x0, x0, 0 from xs where rn=1 union all
  select s.doc_id, s.page_number, s.rn, s.x0, case when s.x0-w.anchor>30 then s.x0 else w.anchor end, case when s.x0-w.anchor>30 then w.col_idx+1 else w.col_idx end
  from xw w join xs s on s.doc_id=w.doc_id and s.page_number=w.page_number and s.rn=w.rn+1),
 anchors as (select distinct doc_id, page_number, anchor, col_idx from xw),
 cols as (select x.doc_id, x.page_number, x.x0, case when a.anchor-x.x0<x.x0-x.anchor then x.col_idx+1 else x.col_idx end as col_idx
  from xw x left join anchors a on a.doc_id=x.doc_id and a.page_number=x.page_number and a.col_idx=x.col_idx+1),
 grid as (select g.doc_id, g.page_number, y.row_idx, c.col_idx, string_agg(g.text,' ' order by g.y0, g.x0, g.word_num) as content,
   (select max(col_idx)+1 from anchors a where a.doc_id=g.doc_id and a.page_number=g.page_number) as n_cols
  from gw g join yw y using (doc_id, page_number, y0) join cols c using (doc_id, page_number, x0) group by g.doc_id, g.page_number, y.row_idx, c.col_idx),
 cells as (select r.doc_id, r.page_number, r.row_idx, r.col_idx, coalesce(g.content,'') as content, r.row_idx=0 as is_header
  from (select doc_id, page_number, row_idx, unnest(range(n_cols)) as col_idx from (select distinct doc_id, page_number, row_idx, n_cols from grid)) r
  left join grid g using (doc_id, page_number, row_idx, col_idx))"""
GRID_VIEWS = (S.LINES, S.BODY, S.WORDS, _GW, _GRID)
_PAGE = ["doc_id", "page_number"]


def _placed_words(spark, root):
    words = derived.words(spark, root).where(F.length(F.trim("text")) > 0)
    return words.select(
        "doc_id", "page_number", "word_num", "text", (F.col("left") + (F.col("line_num") * 7) % 20).alias("x0"), (F.col("top") + (F.col("word_num") * 3) % 4).alias("y0")
    )


def _grid(spark, root):
    return O.words_to_grid(_placed_words(spark, root), _PAGE)


@register("words_to_grid", S.query(*GRID_VIEWS, select="select * from grid", recursive=True))
def words_to_grid(spark, root):
    return _grid(spark, root)


@register("grid_to_cells", S.query(*GRID_VIEWS, select="select * from cells", recursive=True))
def grid_to_cells(spark, root):
    return O.grid_to_cells(_grid(spark, root), _PAGE)


@register("cells_to_csv", S.query(*GRID_VIEWS, """rws as (select doc_id, page_number, row_idx, string_agg(case when regexp_matches(content,'[,"\\r\\n]') then '"'||replace(content,'"','""')||'"' else content end, ',' order by col_idx) as line
  from cells group by all)""", select=f"""select doc_id, page_number, {S.strip("string_agg(line, chr(13)||chr(10) order by row_idx)")} as csv_repr from rws group by all""", recursive=True))
def cells_to_csv(spark, root):
    return O.words_to_csv(_placed_words(spark, root), _PAGE)


# --- document lists, messages ----------------------------------------------------------------------

_LISTS = """titled as (select m.doc_id, case when m.doc_id%11=3 then '' when m.doc_id%13=5 then 'My api_test run' when m.doc_id%4=0 then concat('  Shared title ', m.doc_id%10, ' ') else m.title end as title,
   m.filename, case when m.doc_id%9=0 then null else author_a||', '||author_b end as authors, m.doc_id as pos, l.doc_id is not null as active
  from meta m left join labels l using (doc_id)),
 ranked as (select doc_id, trim(coalesce(nullif(title,''),nullif(filename,''),'Research Paper')) as title, authors, case when active then 0 else 1 end as rank, pos from titled),
 first_of as (select *, row_number() over (partition by title order by rank, pos) as rn from ranked
  where not contains(lower(title),'api_test') and not contains(lower(title),'sample.pdf') and title<>'')"""


@register("list_documents", S.query(S.META, _LISTS, select="""
 select doc_id, title, case when authors is not null then authors when rank=0 then '' else 'Extracted Authors' end as authors,
  case when rank=0 then 'Active' else 'Saved' end as "timestamp" from first_of where rn=1"""))
def list_documents(spark, root):
    doc = F.col("doc_id")
    title = (
        F.when(doc % 11 == 3, "").when(doc % 13 == 5, "My api_test run")
        .when(doc % 4 == 0, F.concat(F.lit("  Shared title "), doc % 10, F.lit(" "))).otherwise(F.col("title"))
    )
    rows = derived.metadata(spark, root).select(
        "doc_id", title.alias("title"), "filename", F.when(doc % 9 != 0, F.col("authors")).alias("authors"), doc.alias("pos")
    )
    labelled = table(spark, root, "labels").select("doc_id").distinct()
    return C.list_documents(rows.join(labelled, "doc_id", "left_semi"), rows.join(labelled, "doc_id", "left_anti"))


_LIB = """library as (select user_id, event_id%1000 as doc_id, concat('Doc ',event_id%1000) as title, event_type as authors, concat('d',event_id%1000,'.pdf') as filename, ts as created_at, event_id from events)"""


def _library(spark, root):
    doc = F.col("event_id") % 1000
    return table(spark, root, "events").select(
        "user_id", doc.alias("doc_id"), F.concat(F.lit("Doc "), doc).alias("title"), F.col("event_type").alias("authors"),
        F.concat(F.lit("d"), doc, F.lit(".pdf")).alias("filename"), F.col("ts").alias("created_at"),
    )


@register("user_documents", S.query(_LIB, select='select user_id, doc_id as id, title, authors, filename, created_at as "timestamp" from library order by user_id, created_at desc, doc_id'))
def user_documents(spark, root):
    return C.user_documents(_library(spark, root))


@register("add_user_document", S.query(_LIB, """existing as (select user_id, doc_id, min(created_at) as created_at from library where authors in ('view','click') group by all),
  incoming as (select user_id, doc_id, min(created_at) as created_at from library where authors not in ('view','click') group by all)""", select="""
 select user_id, doc_id, created_at from existing union all
 select i.user_id, i.doc_id, i.created_at from incoming i where not exists (select 1 from existing e where e.user_id=i.user_id and e.doc_id=i.doc_id)"""))
def add_user_document(spark, root):
    rows = _library(spark, root)
    old = F.col("authors").isin("view", "click")
    existing = rows.where(old).groupBy("user_id", "doc_id").agg(F.min("created_at").alias("created_at"))
    return C.add_user_documents(existing, rows.where(~old).select("user_id", "doc_id", "created_at"))


_MSG = "msg as (select conv_id%50 as user_id, conv_id as doc_id, conv_id*1000+turn as id, role, text as content, '[]' as citations_json, timestamp '2024-01-01' + to_minutes((turn*7)::int) as created_at from conversations)"


def _messages(spark, root):
    return table(spark, root, "conversations").select(
        (F.col("conv_id") % 50).alias("user_id"), F.col("conv_id").alias("doc_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        "role", F.col("text").alias("content"), F.lit("[]").alias("citations_json"),
        F.expr("timestamp '2024-01-01' + make_dt_interval(0, 0, cast(turn * 7 as int), 0)").alias("created_at"),
    )


@register("chat_history", S.query(_MSG, select='select user_id, doc_id, id, role, content, citations_json, created_at as "timestamp" from msg order by user_id, doc_id, created_at, id'))
def chat_history(spark, root):
    return C.chat_history(_messages(spark, root))


@register("save_messages", S.query(_MSG, select="""
 select user_id, doc_id, id, role, content, citations_json, created_at from msg where role<>'assistant' union all
 select user_id, doc_id, id, role, content, case when id%2=0 then concat('[{"source_id":"Source ',id%3+1,'","page":',id%5,'}]') else '[]' end, created_at from msg where role='assistant'"""))
def save_messages(spark, root):
    rows = _messages(spark, root)
    source = F.struct(F.concat(F.lit("Source "), F.col("id") % 3 + 1).alias("source_id"), (F.col("id") % 5).alias("page"))
    new = rows.where("role = 'assistant'").drop("citations_json").withColumn("citations", F.when(F.col("id") % 2 == 0, F.array(source)))
    return C.save_messages(rows.where("role <> 'assistant'"), new)


_UPLOAD = "concat(case when doc_id%3=0 then md5(doc_id::varchar)||'_paper_' when doc_id%3=1 then 'short_' else 'plain' end, doc_id, '.pdf')"


@register("doc_id_from_filename", S.query(f"f as (select doc_id, {_UPLOAD} as filename from documents)", select="""
 select doc_id, filename, case when contains(filename,'_') and length(string_split(filename,'_')[1])>=32 then string_split(filename,'_')[1] else sha256(filename) end as derived_id from f"""))
def doc_id_from_filename(spark, root):
    doc = F.col("doc_id")
    prefix = F.when(doc % 3 == 0, F.concat(F.md5(doc.cast("string").cast("binary")), F.lit("_paper_"))).when(doc % 3 == 1, F.lit("short_")).otherwise(F.lit("plain"))
    rows = table(spark, root, "documents").select("doc_id", F.concat(prefix, doc, F.lit(".pdf")).alias("filename"))
    return rows.withColumn("derived_id", classify.doc_id_from_filename(F.col("filename")))


@register("parse_metadata", S.query(f"""info as (select doc_id, concat(' ', source, ' ,, ', string_split(text,chr(10))[1], ', ', lang, ' ') as author,
   case when doc_id%5=0 then null when doc_id%5=1 then 'D:20' when doc_id%5=2 then 'D:x0y1zz' else concat('D:',1980+doc_id%45,'1105') end as created from documents)""", select=f"""
 select doc_id, array_to_string(list_filter(list_transform(string_split(author,','), lambda x: {S.strip('x')}), lambda x: length(x)>0),'|') as authors,
  case when length(created)>=6 then try_cast(substr(created,3,4) as int) end as publication_year from info"""))
def parse_metadata(spark, root):
    doc = F.col("doc_id")
    author = F.concat(F.lit(" "), "source", F.lit(" ,, "), F.split("text", "\n")[0], F.lit(", "), "lang", F.lit(" "))
    created = F.when(doc % 5 == 0, F.lit(None)).when(doc % 5 == 1, "D:20").when(doc % 5 == 2, "D:x0y1zz").otherwise(
        F.concat(F.lit("D:"), (1980 + doc % 45).cast("string"), F.lit("1105")))
    return table(spark, root, "documents").select(
        "doc_id", F.array_join(classify.author_list(author), "|").alias("authors"), classify.creation_year(created).alias("publication_year")
    )


# --- status and statistics -------------------------------------------------------------------------

def _status(spark, root):
    docs = table(spark, root, "documents")
    return C.ingest_status(docs, {
        "document has no text": F.length(F.trim("text")) > 0,
        "document has a single line": F.size(F.split("text", "\n")) > 1,
    }).select("doc_id", "status", "error_message")


STATUS = """status as (select doc_id, case when length(trim(text))=0 then 'document has no text' when len(string_split(text,chr(10)))<=1 then 'document has a single line' end as error_message from documents)"""


@register("ingest_status", S.query(STATUS, select="select doc_id, case when error_message is null then 'completed' else 'failed' end as status, error_message from status"))
def ingest_status(spark, root):
    return _status(spark, root)


def _count_sql(name, source):
    return f"(select doc_id, count(*) as {name} from {source} group by doc_id) {name}_t"


def _marked(spark, root):
    """Marks of all elements and their blocks, both as tables: what is counted needs no texts."""
    marks = stored(C.element_marks(derived.elements(spark, root)), "marks")
    return marks, stored(C.element_blocks(marks), "blocks")


def _parts(blocks, name):
    return blocks.select("doc_id", F.col(name).alias("n"))


@register("processing_stats", S.query(*CHUNK_VIEWS, S.META, S.WORDS, EQUATIONS, CITES, REFS, _LINES_SQL, S.CAPTIONED, S.FIGURES, S.TABLES, """ocr as (
   select doc_id, page_number, coalesce(avg(c),1.0::double) as mc from (select distinct doc_id, page_number from words) p left join usable u using (doc_id, page_number) group by all)""",
 "op as (select doc_id, count(*) as n, avg(mc) as mc from ocr group by doc_id)", select=f"""
 select m.doc_id, m.page_count as total_pages, coalesce(op.n,0) as ocr_pages, m.page_count-coalesce(op.n,0) as digital_pages, round(coalesce(op.mc,1.0::double)+1e-9::double,6) as ocr_mean_confidence,
  coalesce(elements_detected,0) as elements_detected, coalesce(tables_found,0) as tables_found, coalesce(figures_found,0) as figures_found, coalesce(equations_found,0) as equations_found,
  coalesce(citations_found,0) as citations_found, coalesce(references_found,0) as references_found, coalesce(chunks_created,0) as chunks_created
 from meta m left join op using (doc_id) left join {_count_sql('elements_detected','elements')} using (doc_id) left join {_count_sql('tables_found','tables')} using (doc_id)
 left join {_count_sql('figures_found','figures')} using (doc_id) left join {_count_sql('equations_found','eqs')} using (doc_id) left join {_count_sql('citations_found','cites')} using (doc_id)
 left join {_count_sql('references_found','refs')} using (doc_id) left join {_count_sql('chunks_created','text_chunks')} using (doc_id)""", recursive=True))
def processing_stats(spark, root):
    ocr = O.page_confidence(derived.words(spark, root))
    marks, blocks = _marked(spark, root)
    children = {
        "elements_detected": _parts(blocks, "elements"), "tables_found": derived.tables(spark, marks), "figures_found": derived.figures(spark, marks),
        "equations_found": C.count_equations(marks), "citations_found": _parts(blocks, "citations"), "references_found": citations.count_references(blocks),
        "chunks_created": chunking.count_chunks(blocks),
    }
    return C.processing_stats(derived.metadata(spark, root), ocr, children).withColumn("ocr_mean_confidence", _rounded("ocr_mean_confidence"))


@register("document_summary", S.query(*ALL_CHUNK_VIEWS, S.META, STATUS, select=f"""
 select m.doc_id, m.filename, m.title, author_a||', '||author_b as authors, m.page_count, case when error_message is null then 'completed' else 'failed' end as status,
  coalesce(element_count,0) as element_count, coalesce(table_count,0) as table_count, coalesce(figure_count,0) as figure_count, coalesce(equation_count,0) as equation_count, coalesce(chunk_count,0) as chunk_count
 from meta m left join status using (doc_id) left join {_count_sql('element_count','elements')} using (doc_id) left join {_count_sql('table_count','tables')} using (doc_id)
 left join {_count_sql('figure_count','figures')} using (doc_id) left join {_count_sql('equation_count','eqs')} using (doc_id) left join {_count_sql('chunk_count','all_chunks')} using (doc_id)""", recursive=True))
def document_summary(spark, root):
    marks, blocks = _marked(spark, root)
    tables, figures, formulas = derived.tables(spark, marks), derived.figures(spark, marks), C.count_equations(marks)
    # a chunk of each entity, and those of the text
    entities = [x.select("doc_id", F.lit(1).alias("n")) for x in (tables, figures, formulas)]
    chunks = reduce(DataFrame.unionByName, [chunking.count_chunks(blocks), *entities])
    return C.document_summary(derived.metadata(spark, root), _status(spark, root), {
        "element_count": _parts(blocks, "elements"), "table_count": tables, "figure_count": figures, "equation_count": formulas, "chunk_count": chunks,
    })


@register("corpus_analytics", S.query(*ALL_CHUNK_VIEWS, S.META, """c as (select doc_id, count(*) filter (chunk_type in ('text','abstract')) as t, count(*) filter (chunk_type='table') as b,
   count(*) filter (chunk_type='figure') as f, count(*) filter (chunk_type='equation') as e from all_chunks group by doc_id)""",
 "r as (select m.doc_id, sum(page_count) as pages, sum(coalesce(t,0)) as t, sum(coalesce(b,0)) as b, sum(coalesce(f,0)) as f, sum(coalesce(e,0)) as e from meta m left join c using (doc_id) group by rollup(m.doc_id))", select="""
 select doc_id, pages, pages*2 as reading_minutes, t+b+f+e as n_chunks, b+f as n_tables_figures, e as n_equation,
  case when t+b+f+e>0 then round(t/(t+b+f+e),6) else 0 end as share_text, case when t+b+f+e>0 then round(b/(t+b+f+e),6) else 0 end as share_table,
  case when t+b+f+e>0 then round(f/(t+b+f+e),6) else 0 end as share_figure, case when t+b+f+e>0 then round(e/(t+b+f+e),6) else 0 end as share_equation from r""", recursive=True))
def corpus_analytics(spark, root):
    marks, blocks = _marked(spark, root)
    kinds = {"table": derived.tables(spark, marks), "figure": derived.figures(spark, marks), "equation": C.count_equations(marks)}
    counted = [x.select("doc_id", F.lit(kind).alias("chunk_type"), F.lit(1).alias("n")) for kind, x in kinds.items()]
    text = chunking.count_chunks(blocks).select("doc_id", F.lit("text").alias("chunk_type"), "n")
    return C.corpus_analytics(derived.metadata(spark, root), reduce(DataFrame.unionByName, [text, *counted]))


@register("review_features", S.query(*S.ENTITY_VIEWS, S.META, EQUATIONS, REFS, """hd as (select doc_id, string_agg(content,', ' order by pos) as sections from (
   select *, row_number() over (partition by doc_id order by pos) as rn from elements where element_type in ('heading','subheading')) where rn<=8 group by doc_id),
  ld as (select doc_id, substr(arg_min(content,pos),1,500) as snippet from elements where element_type='paragraph' and length(content)>50 group by doc_id)""", select=f"""
 select m.doc_id, coalesce(title,filename) as title, author_a||', '||author_b as authors, page_count as total_pages, coalesce(sections,'') as sections,
  coalesce(snippet,'No abstract paragraph detected.') as snippet, coalesce(n_tables,0) as n_tables, coalesce(n_figures,0) as n_figures, coalesce(n_equations,0) as n_equations, coalesce(n_references,0) as n_references
 from meta m left join hd using (doc_id) left join ld using (doc_id) left join {_count_sql('n_tables','tables')} using (doc_id) left join {_count_sql('n_figures','figures')} using (doc_id)
 left join {_count_sql('n_equations','eqs')} using (doc_id) left join {_count_sql('n_references','refs')} using (doc_id)"""))
def review_features(spark, root):
    return A.review_features(
        derived.elements(spark, root), derived.metadata(spark, root), derived.tables(spark, root), derived.figures(spark, root),
        all_equations(spark, root), all_references(spark, root),
    )
