"""Queries on elements, sections, trees and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import chunking, sections
from quire.plans import derived
from quire.plans import derived_sql as S
from quire.plans.registry import register
from quire.sources import raw
from quire.sources.tables import table

_SECTION_TYPES = "('title','heading','subheading','abstract','references')"
_NO_TEXT = "('table','figure','equation','header','footer','page_number')"


@register("text_to_elements", S.query(S.LINES, select=f"""
 select doc_id, pos, (floor(pos/8)+1)::int as page_number, (pos%8)::int as reading_order,
  case when pos=0 then 'title' else 'paragraph' end as element_type, {S.strip('line')} as content
 from lines where length({S.strip('line')})>0"""))
def text_to_elements(spark, root):
    return raw.text_to_elements(table(spark, root, "documents"))


@register("html_to_elements", f"""
 with dropped as (
  select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
   '(?is)<script\\b[^>]*>.*?</script\\s*>',' ','g'), '(?is)<style\\b[^>]*>.*?</style\\s*>',' ','g'),
   '(?is)<nav\\b[^>]*>.*?</nav\\s*>',' ','g'), '(?s)<!--.*?-->',' ','g') as h from pages),
 marked as (select page_id, string_split(regexp_replace(h,
   '(?i)(</?(?:h1|p|li|ul|ol|div|article|section|footer|body|html)\\b)', chr(1)||'\\1', 'g'), chr(1)) as parts from dropped),
 pieces as (select page_id, unnest(range(len(parts))) as i, unnest(parts) as part from marked),
 blocks as (select page_id, row_number() over (partition by page_id order by i)-1 as k,
   lower(regexp_extract(part,'(?i)^<(h1|p|li)\\b',1)) as tag, regexp_replace(part,'(?is)^<(h1|p|li)\\b[^>]*>','') as body
  from pieces where regexp_matches(part,'(?is)^<(h1|p|li)\\b[^>]*>')),
 cleaned as (select page_id, k, tag, trim(regexp_replace(
   replace(replace(replace(replace(replace(replace(regexp_replace(body,'(?s)<[^>]*>',' ','g'),
    '&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&nbsp;',' '),'&amp;','&'), '\\s+',' ','g')) as content from blocks)
 select page_id as doc_id, k as pos, 1 as page_number, k as reading_order,
  case tag when 'h1' then 'title' when 'p' then 'paragraph' else 'unknown' end as element_type, content
 from cleaned where length(content)>0""")
def html_to_elements(spark, root):
    return raw.html_to_elements(table(spark, root, "pages"))


@register("derived_elements", S.query(*S.DOC_VIEWS, select="select * from elements"))
def derived_elements(spark, root):
    return derived.elements(spark, root)


@register("estimate_tokens", f"""
 select doc_id, {S.tokens('text')} as tokens, floor(length(text)/4)::int as tokens_unfloored from documents""")
def estimate_tokens(spark, root):
    text = F.col("text")
    return table(spark, root, "documents").select(
        "doc_id", T.estimate_tokens(text).alias("tokens"), T.estimate_tokens_unfloored(text).alias("tokens_unfloored")
    )


_SENTENCES = "string_split(regexp_replace({t},'([.!?])\\s+([A-Z0-9])','\\1'||chr(31)||'\\2','g'),chr(31))"


@register("split_sentences", f"""
 with s as (select doc_id, {_SENTENCES.format(t='text')} as parts from documents)
 select doc_id, unnest(range(len(parts))) as k, unnest(parts) as sentence from s""")
def split_sentences(spark, root):
    return table(spark, root, "documents").select(
        "doc_id", F.posexplode_outer(T.split_sentences(F.col("text"))).alias("k", "sentence")
    )


_PLACED = f"""placed as (
 select *, coalesce(max(case when element_type in {_SECTION_TYPES} then pos end)
   over (partition by doc_id order by pos rows between unbounded preceding and current row), -1) as section_pos from elements),
 text_rows as (
 select p.doc_id, p.pos, p.page_number, p.content, p.x0, p.y0, p.x1, p.y1, p.section_pos, coalesce(h.content,'Main') as section,
  case when h.doc_id is null then 0 when h.element_type in ('title','abstract') then 0 when h.element_type='heading' then 1 else 2 end as section_level
 from placed p left join elements h on p.doc_id=h.doc_id and p.section_pos=h.pos
 where p.element_type not in {_SECTION_TYPES} and p.element_type not in {_NO_TEXT})"""


@register("assign_sections", S.query(*S.DOC_VIEWS, _PLACED, select="""
 select doc_id, pos, section, section_level, section_pos from text_rows"""))
def assign_sections(spark, root):
    return sections.assign_sections(derived.elements(spark, root)).select(
        "doc_id", "pos", "section", "section_level", "section_pos"
    )


@register("hierarchy_sections", S.query(*S.DOC_VIEWS, f"""flagged as (
  select doc_id, pos, page_number, element_type, {S.strip('content')} as title,
   element_type in {_SECTION_TYPES}
   or regexp_matches({S.strip('content')}, '(?i)^(abstract|references|bibliography|introduction|related work|background|methodology|experiments|results|discussion|conclusion|appendix)')
   or (regexp_matches({S.strip('content')}, '^[0-9]+(\\.[0-9]+)*\\s+[A-Z]') and length({S.strip('content')})<80) as is_header
  from elements where length({S.strip('content')})>0)""", """numbered as (
  select *, coalesce(max(case when is_header then pos end) over (partition by doc_id order by pos),-1) as section_pos from flagged)""", select="""
 select doc_id, section_pos,
  case when section_pos>=0 then arg_min(title,pos) else 'Document Title & Author Metadata' end as title,
  case when section_pos>=0 then arg_min(element_type,pos) else 'HEADING' end as section_type,
  min(page_number) as page_number,
  case when section_pos>=0 and arg_min(element_type,pos)='subheading' then 2 else 1 end as level,
  sum(case when is_header then 0 else 1 end) as n_elements
 from numbered group by doc_id, section_pos"""))
def hierarchy_sections(spark, root):
    return sections.hierarchy_sections(derived.elements(spark, root))


_LEVEL = """case element_type when 'title' then 0 when 'heading' then 1 when 'subheading' then 2 when 'abstract' then 1
 when 'references' then 1 when 'appendix' then 1 when 'authors' then 1 when 'caption' then 4 when 'citation' then 4
 when 'header' then 5 when 'footer' then 5 when 'page_number' then 5 else 3 end"""
_TREE = f"""leveled as (select *, {_LEVEL} as level from elements),
 parented as (
  select l.doc_id, l.pos, l.level, l.content, l.page_number, l.reading_order,
   max(s.pos) as parent_pos
  from leveled l left join leveled s on s.doc_id=l.doc_id and s.pos<l.pos and s.level<=2 and s.level<l.level
  group by all),
 tree as (
  select p.*, 1 + (p.parent_pos is not null)::int + (q.parent_pos is not null)::int + (r.parent_pos is not null)::int as depth,
   q.parent_pos as grand_pos, r.parent_pos as great_pos
  from parented p left join parented q on q.doc_id=p.doc_id and q.pos=p.parent_pos
   left join parented r on r.doc_id=p.doc_id and r.pos=q.parent_pos)"""


def _tree(spark, root):
    return sections.section_tree(derived.elements(spark, root))


@register("tree_parent", S.query(*S.DOC_VIEWS, _TREE, select="select doc_id, pos, level, parent_pos, depth from tree"))
def tree_parent(spark, root):
    return _tree(spark, root).select("doc_id", "pos", "level", "parent_pos", "depth")


@register("tree_depth", S.query(*S.DOC_VIEWS, _TREE, select="""
 select doc_id, count(*) as total_nodes, max(depth) as max_depth from tree group by doc_id"""))
def tree_depth(spark, root):
    return sections.tree_depth(_tree(spark, root))


@register("tree_sections", S.query(*S.DOC_VIEWS, _TREE, select="""
 select doc_id, pos, page_number, reading_order, level, content as section_title from tree where level<=2 and content<>''"""))
def tree_sections(spark, root):
    return sections.tree_sections(_tree(spark, root))


_MEMBERS = """members as (
 select doc_id, pos as node_pos, pos, content from tree
 union all select doc_id, parent_pos, pos, content from tree where parent_pos is not null
 union all select doc_id, grand_pos, pos, content from tree where grand_pos is not null
 union all select doc_id, great_pos, pos, content from tree where great_pos is not null)"""


@register("tree_subtree", S.query(*S.DOC_VIEWS, _TREE, _MEMBERS, select="""
 select doc_id, node_pos, count(*) as n_elements, sum(length(content))+count(*)-1 as n_chars, count(*)=1 as is_leaf
 from members group by doc_id, node_pos"""))
def tree_subtree(spark, root):
    return sections.tree_subtree(_tree(spark, root))


@register("subtree_text", S.query(*S.DOC_VIEWS, _TREE, _MEMBERS, select="""
 select doc_id, node_pos, count(*) as n_elements, string_agg(content, chr(10) order by pos) as text
 from members m where exists (select 1 from tree t where t.doc_id=m.doc_id and t.pos=m.node_pos and t.level=1)
 group by doc_id, node_pos"""))
def subtree_text(spark, root):
    tree = _tree(spark, root)
    return sections.subtree_text(tree, tree.where("level = 1").select("doc_id", F.col("pos").alias("node_pos")))


_CHUNKS = f"""units as (
 select *, {S.strip('content')} as txt, {S.tokens(S.strip('content'))} as size from text_rows where length({S.strip('content')})>0),
 numbered as (
 select *, row_number() over (partition by doc_id, section_pos order by pos) as rn from units),
 walked(doc_id, section_pos, rn, fill, bin_pos) as (
  select doc_id, section_pos, rn, case when size>512 then 0 else size end, case when size>512 then null else pos end from numbered where rn=1
  union all
  select n.doc_id, n.section_pos, n.rn,
   case when n.size>512 then 0 when w.fill+n.size>512 then n.size else w.fill+n.size end,
   case when n.size>512 then null when w.fill=0 or w.fill+n.size>512 then n.pos else w.bin_pos end
  from walked w join numbered n on n.doc_id=w.doc_id and n.section_pos=w.section_pos and n.rn=w.rn+1),
 packed as (
  select n.doc_id, n.section, n.section_level, w.bin_pos as first_pos, 0 as part,
   string_agg(n.txt, chr(10)||chr(10) order by n.pos) as content, arg_max(n.page_number, n.pos) as page_number,
   min(n.x0) as x0, min(n.y0) as y0, max(n.x1) as x1, max(n.y1) as y1,
   string_agg(concat(n.doc_id,':',n.pos), '|' order by n.pos) as element_ids
  from numbered n join walked w using (doc_id, section_pos, rn) where w.bin_pos is not null
  group by n.doc_id, n.section_pos, n.section, n.section_level, w.bin_pos),
 sent_lists as (
  select doc_id, section, section_level, pos, page_number, x0, y0, x1, y1,
   {_SENTENCES.format(t='txt')} as parts from units where size>512),
 sents as (
  select * exclude (parts), unnest(range(len(parts))) as i, unnest(parts) as sent from sent_lists),
 sized as (select *, {S.tokens('sent')} as size from sents),
 swalk(doc_id, pos, i, fill, part) as (
  select doc_id, pos, i, size, 0 from sized where i=0
  union all
  select n.doc_id, n.pos, n.i, case when w.fill+n.size>512 then n.size else w.fill+n.size end,
   case when w.fill+n.size>512 then w.part+1 else w.part end
  from swalk w join sized n on n.doc_id=w.doc_id and n.pos=w.pos and n.i=w.i+1),
 split as (
  select s.doc_id, s.section, s.section_level, s.pos as first_pos, w.part,
   string_agg(s.sent, chr(10)||chr(10) order by s.i) as content, s.page_number, s.x0, s.y0, s.x1, s.y1,
   concat(s.doc_id,':',s.pos) as element_ids
  from sized s join swalk w using (doc_id, pos, i)
  group by s.doc_id, s.section, s.section_level, s.pos, w.part, s.page_number, s.x0, s.y0, s.x1, s.y1),
 text_chunks as (
  select concat(doc_id,':text:',first_pos,':',part) as chunk_id, doc_id,
   case when contains(lower(section),'abstract') then 'abstract' else 'text' end as chunk_type,
   content, page_number, section, section_level, x0, y0, x1, y1, element_ids,
   {S.tokens('content')} as token_count, first_pos, part
  from (select * from packed union all by name select * from split))"""
CHUNK_VIEWS = (*S.DOC_VIEWS, _PLACED, _CHUNKS)


def text_chunks(spark, root):
    return chunking.pack_chunks(derived.elements(spark, root))


def _joined_ids(df):
    return df.withColumn("element_ids", F.array_join("element_ids", "|"))


@register("pack_chunks", S.query(*CHUNK_VIEWS, select="select * from text_chunks", recursive=True))
def pack_chunks(spark, root):
    return _joined_ids(text_chunks(spark, root))


@register("bbox_union", S.query(*CHUNK_VIEWS, select="""
 select chunk_id, page_number, x0, y0, x1, y1 from text_chunks""", recursive=True))
def bbox_union(spark, root):
    return text_chunks(spark, root).select("chunk_id", "page_number", "x0", "y0", "x1", "y1")
