"""Queries on citations, references, equations, captions and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import classify, geometry
from quire.functions import mathematics as M
from quire.functions import references as R
from quire.functions import text as T
from quire.operators import citations, equations, layout
from quire.plans import derived
from quire.plans import derived_sql as S
from quire.plans.registry import register

# --- citations -----------------------------------------------------------------------------

_NUM = r"\[([0-9]+(?:\s*[,;–-]\s*[0-9]+)*)\]"
_AY = r"\(([A-Z][a-zA-Z]+(?:\s+(?:et\s+al\.?|and|&)\s+[A-Z][a-zA-Z]+)?(?:\s*,\s*[0-9]{4})?)\)"
_IN = r"([A-Z][a-zA-Z]+(?:\s+et\s+al\.?)?)\s+\(([0-9]{4})\)"


def _cite_sql(kind, pattern):
    key = (f"concat(regexp_extract(m, '{pattern}', 1), ' (', regexp_extract(m, '{pattern}', 2), ')')" if kind == "inline" else "m")
    return f"""select doc_id, pos, page_number, '{kind}' as kind, i as match_pos, {key} as cite_key, content, m,
      list_sum(list_transform(gaps[1:i+1], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))),0) as st
     from (select *, unnest(range(len(ms))) as i, unnest(ms) as m from (
      select doc_id, pos, page_number, content, regexp_extract_all(content, '{pattern}') as ms, string_split_regex(content, '{pattern}') as gaps
      from elements where element_type<>'references'))"""


CITES = f"""found as ({_cite_sql('numeric', _NUM)} union all {_cite_sql('author_year', _AY)} union all {_cite_sql('inline', _IN)}),
 cites as (
  select concat(doc_id,':',pos,':',kind,':',match_pos) as citation_id, doc_id, pos, kind, match_pos, page_number, cite_key,
   {S.strip("substr(content, (greatest(0,st-50)+1)::int, (least(length(content), st+length(m)+50)-greatest(0,st-50))::int)")} as context
  from found)"""

_DOI = r"(?i)(?:doi:\s*|https?://doi\.org/)(10\.[0-9]{4,}/\S+)"
_SEP = r"\s*(?:,\s*and\s+|,\s*&\s*|\s+and\s+|\s*;\s*|,\s*)"
REFS = f"""bounds as (
  select doc_id, coalesce(min(case when element_type='references' then pos end),
    min(case when lower({S.strip('content')}) in ('references','bibliography','works cited') then pos end)) as start_pos
  from elements group by doc_id),
 stops as (
  select e.doc_id, min(e.pos) as stop_pos from elements e join bounds b on e.doc_id=b.doc_id and e.pos>b.start_pos
  where e.element_type in ('heading','title','appendix') group by e.doc_id),
 entries as (
  select e.doc_id, e.pos, {S.strip('e.content')} as raw_text,
   case when regexp_matches({S.strip('e.content')}, '^\\[([0-9]+)\\]\\s*([^\\n]+)') then {S.strip("regexp_extract(" + S.strip('e.content') + ", '^\\[([0-9]+)\\]\\s*([^\\n]+)', 2)")}
    else {S.strip('e.content')} end as body
  from elements e join bounds b on e.doc_id=b.doc_id and e.pos>b.start_pos left join stops s on s.doc_id=e.doc_id
  where (s.stop_pos is null or e.pos<s.stop_pos) and length({S.strip('e.content')})>=10),
 parts as (select *, string_split(body,'.') as seg from entries),
 refs as (
  select concat(doc_id,':ref:',pos) as reference_id, doc_id, pos, raw_text,
   try_cast(nullif(regexp_extract(raw_text,'^\\[([0-9]+)\\]',1),'') as bigint) as ref_index,
   case when len(seg)>=2 then list_filter(list_transform(string_split_regex(regexp_replace({S.strip('seg[1]')},'^\\[[0-9]+\\]\\s*',''), '{_SEP}'),
     lambda x: regexp_replace({S.strip('x')},'\\.+$','')), lambda x: length(x)>1) else [] end as authors,
   case when len(seg)>=3 then {S.strip('seg[2]')} end as title,
   case when len(seg)>=3 then nullif(regexp_replace({S.strip("regexp_replace(regexp_replace(" + S.strip("array_to_string(seg[3:],'.')") + ", '" + _DOI + "','','g'),'https?://\\S+','','g')")},'\\.+$',''),'') end as venue,
   try_cast(regexp_extract_all(body,'\\b((?:19|20)[0-9]{{2}})\\b')[-1] as int) as year,
   nullif(regexp_extract(body,'{_DOI}',1),'') as doi,
   coalesce('https://arxiv.org/abs/'||nullif(regexp_extract(body,'(?i)arXiv:([0-9]{{4}}\\.[0-9]{{4,5}}(?:v[0-9]+)?)',1),''),
    regexp_replace(nullif(regexp_extract(body,'https?://\\S+',0),''),'\\.+$','')) as url
  from parts)"""

LINKS = r"""by_number as (select doc_id, ref_index, arg_max(reference_id, pos) as rid from refs where ref_index is not null group by all),
 names as (select doc_id, pos, reference_id, unnest(authors) as author from refs),
 by_name as (select doc_id, lower(regexp_extract(author,'(\S+)\s*$',1)) as surname, arg_min(reference_id,pos) as rid from names group by all),
 linked as (
  select c.*, coalesce(n.rid, a.rid) as reference_id from (
   select *, try_cast(nullif(regexp_extract(cite_key,'^\[([0-9]+)\]',1),'') as bigint) as idx,
    lower(regexp_extract(regexp_replace(cite_key,'[(),]',' ','g'),'^\s*(\S+)',1)) as first_word from cites) c
  left join by_number n on n.doc_id=c.doc_id and n.ref_index=c.idx
  left join by_name a on a.doc_id=c.doc_id and a.surname=c.first_word and c.idx is null)"""

CITE_VIEWS = (*S.DOC_VIEWS, CITES, REFS, LINKS)


def all_citations(spark, root):
    return citations.extract_citations(derived.elements(spark, root))


def all_references(spark, root):
    return citations.extract_references(derived.elements(spark, root))


def linked_citations(spark, root):
    return citations.link_citations(all_citations(spark, root), all_references(spark, root))


@register("extract_citations", S.query(*S.DOC_VIEWS, CITES, select="select * from cites"))
def extract_citations(spark, root):
    return all_citations(spark, root)


@register("parse_reference", S.query(*S.DOC_VIEWS, REFS, select="""
 select reference_id, doc_id, pos, raw_text, ref_index, array_to_string(authors,'|') as authors, title, venue, year, doi, url from refs"""))
def parse_reference(spark, root):
    return all_references(spark, root).withColumn("authors", F.array_join("authors", "|"))


@register("reference_year", S.query(*S.DOC_VIEWS, """spans as (
  select doc_id, pos, concat(content, case when pos%2=0 then ' (1987) reprinted 2011' else ' 19999 v2004' end) as entry from elements)""", select="""
 select doc_id, pos, try_cast(regexp_extract_all(entry,'\\b((?:19|20)[0-9]{2})\\b')[-1] as int) as year,
  case when len(regexp_extract_all(entry,'\\b((?:19|20)[0-9]{2})\\b'))<2 then try_cast(regexp_extract_all(entry,'\\b((?:19|20)[0-9]{2})\\b')[-1] as int)
   when try_cast(regexp_extract_all(entry,'\\b((?:19|20)[0-9]{2})\\b')[-1] as int)>=2000 then 2020 else 1919 end as parity_year
 from spans"""))
def reference_year(spark, root):
    entry = F.concat(
        "content", F.when(F.col("pos") % 2 == 0, " (1987) reprinted 2011").otherwise(" 19999 v2004")
    )
    return derived.elements(spark, root).select(
        "doc_id", "pos", R.publication_year(entry).alias("year"), R.publication_year(entry, parity=True).alias("parity_year")
    )


@register("parse_authors", S.query(*S.DOC_VIEWS, f"""named as (
  select doc_id, pos, concat('[',pos,'] Okafor B., and ', substr(content,1,40), '; Lindqvist, C & Q, & ', content) as raw from elements)""", select=f"""
 select doc_id, pos, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(raw,'^\\[[0-9]+\\]\\s*',''),'{_SEP}'),
  lambda x: regexp_replace({S.strip('x')},'\\.+$','')), lambda x: length(x)>1),'|') as authors from named"""))
def parse_authors(spark, root):
    raw = F.concat(
        F.lit("["), "pos", F.lit("] Okafor B., and "), F.substring("content", 1, 40), F.lit("; Lindqvist, C & Q, & "), "content"
    )
    return derived.elements(spark, root).select(
        "doc_id", "pos", F.array_join(R.author_names(raw), "|").alias("authors")
    )


@register("link_citations", S.query(*CITE_VIEWS, select="""
 select citation_id, doc_id, kind, cite_key, reference_id from linked"""))
def link_citations(spark, root):
    return linked_citations(spark, root).select("citation_id", "doc_id", "kind", "cite_key", "reference_id")


@register("link_citations_expanded", S.query(*S.DOC_VIEWS, CITES, REFS, r"""key_parts as (
  select citation_id, doc_id, kind, cite_key, unnest(case when kind='numeric' then regexp_extract_all(cite_key,'[0-9]+(?:\s*[–-]\s*[0-9]+)?') else [null] end) as p from cites),
 ranges as (
  select *, least(regexp_extract(p,'^([0-9]+)',1)::bigint, regexp_extract(p,'([0-9]+)$',1)::bigint) as low,
   greatest(regexp_extract(p,'^([0-9]+)',1)::bigint, regexp_extract(p,'([0-9]+)$',1)::bigint) as high from key_parts)""",
 LINKS.split(",\n linked as")[0], """nums as (
  select distinct r.citation_id, r.doc_id, r.cite_key, coalesce(n.ref_index, case when low=high then low end) as ref_index
  from ranges r left join by_number n on n.doc_id=r.doc_id and n.ref_index between r.low and r.high)""", select=r"""
 select c.citation_id, c.ref_index, coalesce(n.rid,a.rid) as reference_id from nums c
 left join by_number n on n.doc_id=c.doc_id and n.ref_index=c.ref_index
 left join by_name a on a.doc_id=c.doc_id and c.ref_index is null and a.surname=lower(regexp_extract(regexp_replace(cite_key,'[(),]',' ','g'),'^\s*(\S+)',1))"""))
def link_citations_expanded(spark, root):
    return citations.link_citations(all_citations(spark, root), all_references(spark, root), expand=True).select(
        "citation_id", "ref_index", "reference_id"
    )


@register("link_author_year", S.query(*CITE_VIEWS, select="""
 select citation_id, cite_key, reference_id from linked where kind<>'numeric'"""))
def link_author_year(spark, root):
    return citations.link_author_year(all_citations(spark, root), all_references(spark, root)).select(
        "citation_id", "cite_key", "reference_id"
    )


@register("citation_orbits", S.query(*S.DOC_VIEWS, REFS, """numbered as (
  select *, row_number() over (partition by doc_id order by pos)-1 as idx from refs),
 first12 as (select *, count(*) over (partition by doc_id) as n from numbered where idx<12),
 halves as (select *, ceil(n/2)::int as half from first12)""", select="""
 select doc_id, idx, reference_id, coalesce(nullif(title,''), concat('Extracted Reference #',idx+1)) as title,
  array_to_string(authors,', ') as authors, coalesce(year::varchar,'2021') as year,
  case when idx<half then 'prior' else 'derivative' end as orbit,
  ((case when idx<half then idx else idx-half end)*(360.0::double/greatest(case when idx<half then half else n-half end,1))+case when idx<half then 15 else 45 end)%360 as angle,
  case when idx<half then 210 else 330 end as distance, greatest(0.65::double, 0.95::double-idx*0.03::double) as similarity
 from halves"""))
def citation_orbits(spark, root):
    return citations.citation_orbits(all_references(spark, root))


# --- equations -----------------------------------------------------------------------------

_ASCII = r"regexp_replace({t},'[\x{AA}-\x{BA}\x{C0}-\x{2FF}\x{370}-\x{3FF}]','ZZ','g')"
_EXCLUDED = ("'and','or','not','the','for','all','any','let','if','then','else','where','with','from','into','over','under',"
             "'sin','cos','tan','log','exp','lim','max','min','sup','inf','frac','sqrt','sum','prod','int','text','mathrm','mathbf',"
             "'left','right','big','cdot','times','div'")
_LABEL = r"\(\s*[A-Za-z]?[0-9]+(?:\.[0-9]+)?\s*\)\s*$"
_DISPLAY = (r"(?s)\$\$(.+?)\$\$|\\begin\{(?:equation|align|gather|multline|eqnarray)\*?\}(.+?)"
            r"\\end\{(?:equation|align|gather|multline|eqnarray)\*?\}")


def _vars_sql(t):
    src = _ASCII.replace("{t}", t)
    return (f"(list_filter(regexp_extract_all({src}, '\\b([a-zA-Z](?:_\\{{[^}}]+\\}}|_[a-zA-Z0-9])?)\\b', 1), "
            f"lambda v: lower(v) not in ({_EXCLUDED}) and length(v)<=10))")


def _ordered_distinct(lst):
    return f"list_filter({lst}, lambda v, i: list_position({lst}, v)=i)"


_COMMANDS = (r"\\(?:frac|sqrt|sum|prod|int|lim|log|exp|sin|cos|tan|max|min|sup|inf|alpha|beta|gamma|delta|epsilon|theta|lambda|mu|sigma|omega|phi|psi"
             r"|mathbb|mathcal|mathbf|mathrm|mathit|text|operatorname|left|right|big|Big|bigg|Bigg|cdot|times|div|pm|mp|leq|geq|neq|approx|equiv|sim|propto"
             r"|infty|partial|nabla|forall|exists|in|notin|subset|supset|cup|cap|oplus|otimes|vec|hat|bar|tilde|dot)\b")


def _score_sql(t):
    a = _ASCII.replace("{t}", t)
    n = lambda src, pat: f"len(regexp_extract_all({src},'{pat}'))"
    ops = n(t, "[=<>≤≥≠±∓∑∏∫∂∇≈∝∞→←↔⊂⊃∈∉∪∩⊕⊗]")
    return f"""(case when length({t})<3 then 0.0::double else greatest(0.0::double, least(1.0::double,
      least(0.4::double,{ops}*0.15::double) + least(0.3::double,{n(t, '[αβγδεζηθικλμνξπρστυφχψωΓΔΘΛΞΠΣΦΨΩ]')}*0.1::double)
      + least(0.4::double,{n(a, _COMMANDS)}*0.15::double) + least(0.2::double,{n(a, chr(92) + 'b[a-zA-Z]' + chr(92) + 's*' + chr(92) + '([a-zA-Z0-9,' + chr(92) + 's|]+' + chr(92) + ')')}*0.05::double)
      + least(0.2::double,{n(t, '[_^][{][^' + chr(92) + 'n]*?[}]|[_^][a-zA-Z0-9]')}*0.05::double)
      + case when length({t})<100 and {ops}>=1 then 0.2::double else 0.0::double end - case when length({t})>180 then 0.3::double else 0.0::double end
      + case when regexp_matches({t},'{_LABEL}') then 0.25::double else 0.0::double end)) end)"""


_CLEAN = (r"replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({t},'^\$\$\s*',''),'\s*\$\$$',''),"
          r"'∈R','\in \mathbb{R}'),'∈ R','\in \mathbb{R}'),'Proj (','\text{Proj}('),'Enc (','\text{Enc}('),'Aug (','\text{Aug}('),'exp (','\exp('),'•','\cdot')")
_BODY = f"(case when regexp_extract(m,'{_DISPLAY}',1)<>'' then regexp_extract(m,'{_DISPLAY}',1) else regexp_extract(m,'{_DISPLAY}',2) end)"
_STR = S.strip("content")
_UNLABELLED = f"(case when regexp_matches({_STR},'{_LABEL}') then {S.strip(f'regexp_replace({_STR},{chr(39)}{_LABEL}{chr(39)},{chr(39)}{chr(39)})')} else {_STR} end)"


EQUATIONS = f"""raw_eq as (
  select doc_id, pos, page_number, 0 as source_order, 0 as match_pos, {_UNLABELLED} as key, {_UNLABELLED} as raw_text,
   case when regexp_extract({_STR},'{_DISPLAY}',1)<>'' then {S.strip(f"regexp_extract({_STR},'{_DISPLAY}',1)")}
    when regexp_extract({_STR},'{_DISPLAY}',0)<>'' then {S.strip(f"regexp_extract({_STR},'{_DISPLAY}',0)")} else {_CLEAN.replace('{t}', _STR)} end as latex,
   false as is_inline, {_STR} as var_source, x0, y0, x1, y1
  from elements where element_type='equation' and length({_STR})>0
  union all
  select doc_id, pos, page_number, 1, i, {S.strip(_BODY)}, {S.strip('m')}, {S.strip(_BODY)}, false, {_BODY}, x0, y0, x1, y1
  from (select *, unnest(range(len(ms))) as i, unnest(ms) as m from (
   select doc_id, pos, page_number, x0, y0, x1, y1, regexp_extract_all(content,'{_DISPLAY}') as ms from elements where element_type<>'equation'))
  union all
  select doc_id, pos, page_number, 2, i, {S.strip('b')}, concat('$',b,'$'), {S.strip('b')}, true, b, x0, y0, x1, y1
  from (select *, unnest(range(len(bs))) as i, unnest(bs) as b from (
   select doc_id, pos, page_number, x0, y0, x1, y1, regexp_extract_all(regexp_replace(content,'\\$\\$+',chr(2),'g'),'\\$([^\\n$]+)\\$',1) as bs from elements where element_type<>'equation'))
  union all
  select doc_id, pos, page_number, 3, 0, {_STR}, {_STR}, {_CLEAN.replace('{t}', _STR)}, length({_STR})<80, {_STR}, x0, y0, x1, y1
  from elements where element_type='paragraph' and length(content)<250 and {_score_sql('content')}>=0.55::double),
 eqs as (
  select concat(doc_id,':eq:',pos,':',source_order,':',match_pos) as equation_id, *, {_vars_sql('var_source')} as vs
  from raw_eq qualify row_number() over (partition by doc_id, key order by pos, source_order, match_pos)=1)"""


def all_equations(spark, root):
    return equations.extract_equations(derived.elements(spark, root))


@register("extract_equations", S.query(*S.DOC_VIEWS, EQUATIONS, select="""
 select doc_id, pos, page_number, x0, y0, x1, y1, source_order, match_pos, key, raw_text, latex, is_inline from raw_eq"""))
def extract_equations(spark, root):
    return equations.equation_candidates(derived.elements(spark, root)).drop("variables")


@register("dedupe_equations", S.query(*S.DOC_VIEWS, EQUATIONS, select=f"""
 select equation_id, doc_id, pos, source_order, match_pos, page_number, x0, y0, x1, y1, raw_text, latex, is_inline,
  array_to_string({_ordered_distinct('vs')},'|') as variables from eqs"""))
def dedupe_equations(spark, root):
    return all_equations(spark, root).withColumn("variables", F.array_join("variables", "|"))


@register("math_score", S.query(*S.DOC_VIEWS, select=f"select doc_id, pos, round({_score_sql('content')},6) as score from elements"))
def math_score(spark, root):
    return derived.elements(spark, root).select("doc_id", "pos", F.round(M.math_score(F.col("content")), 6).alias("score"))


@register("equation_variables", S.query(*S.DOC_VIEWS, f"v as (select doc_id, pos, {_vars_sql('content')} as vs from elements)", select=f"""
 select doc_id, pos, array_to_string({_ordered_distinct('vs')},'|') as variables from v"""))
def equation_variables(spark, root):
    return derived.elements(spark, root).select("doc_id", "pos", F.array_join(M.variables(F.col("content")), "|").alias("variables"))


@register("equation_label_strip", S.query(*S.DOC_VIEWS, select=f"""
 select doc_id, pos, {_UNLABELLED} as raw, nullif({S.strip(f"regexp_extract({_STR},'{_LABEL}',0)")},'') as label from elements"""))
def equation_label_strip(spark, root):
    content = T.strip(F.col("content"))
    return derived.elements(spark, root).select("doc_id", "pos", M.strip_label(content).alias("raw"), M.label_of(content).alias("label"))


@register("clean_to_latex", S.query(*S.DOC_VIEWS, r"""noisy as (
  select doc_id, pos, concat('$$ ', content, case pos%4 when 0 then ' x ∈R' when 1 then ' exp (• y)' when 2 then ' Proj (z) ∈ R' else ' Enc (Aug (q))' end, ' $$') as t from elements)""",
 select=f"select doc_id, pos, {_CLEAN.replace('{t}', S.strip('t'))} as latex from noisy"))
def clean_to_latex(spark, root):
    tail = F.element_at(F.array(*[F.lit(x) for x in [" x ∈R", " exp (• y)", " Proj (z) ∈ R", " Enc (Aug (q))"]]), (F.col("pos") % 4 + 1).cast("int"))
    text = F.concat(F.lit("$$ "), "content", tail, F.lit(" $$"))
    return derived.elements(spark, root).select("doc_id", "pos", M.clean_to_latex(text).alias("latex"))


# --- regions and captions ------------------------------------------------------------------

_EQ_LIKE = (f"(length({_STR})>=3 and (regexp_matches(content,'[=<>≤≥≠±∓∑∏∫∂∇]')::int + regexp_matches({_ASCII.replace('{t}','content')},"
            r"'\\(?:frac|sqrt|sum|int|prod|lim|log|exp|sin|cos|tan|alpha|beta|gamma|theta|lambda|sigma|delta|omega|phi|psi|epsilon|mu|pi|infty|partial|nabla|mathbb|mathcal|mathbf|mathrm|begin|end)\b')::int"
            f" + regexp_matches({_ASCII.replace('{t}','content')}," r"'\b[a-zA-Z]\s*\(\s*[a-zA-Z]\s*\)')::int"
            f" + regexp_matches({_ASCII.replace('{t}','content')}," r"'\b\d+\s*[+*/^-]\s*\d+')::int"
            " + regexp_matches(content,'[αβγδεζηθικλμνξπρστυφχψω]')::int)>=2)")
REGIONS = f"""regions as (
 select *, case when element_type in ('table','figure','equation','caption','header','footer','page_number') then element_type
  when regexp_matches({_STR},'(?i)^(?:Figure|Fig\\.?|Table|Tab\\.?|Equation|Eq\\.?)\\s*\\d+') then 'caption'
  when y0<0.06::double and font_size<10 and font_size<>0 then 'header' when y1>0.94::double and font_size<10 and font_size<>0 then 'footer'
  when {_EQ_LIKE} then 'equation' else 'text' end as region_type from elements)"""


@register("is_equation_like", S.query(*S.DOC_VIEWS, select=f"select doc_id, pos, {_EQ_LIKE} as equation_like from elements"))
def is_equation_like(spark, root):
    return derived.elements(spark, root).select("doc_id", "pos", geometry.equation_like(F.col("content")).alias("equation_like"))


@register("classify_region", S.query(*S.DOC_VIEWS, REGIONS, select="select doc_id, pos, region_type from regions"))
def classify_region(spark, root):
    return layout.classify_regions(derived.elements(spark, root)).select("doc_id", "pos", "region_type")


@register("merge_regions", S.query(*S.DOC_VIEWS, REGIONS, """ranked as (
  select *, row_number() over (partition by doc_id, page_number order by y0, pos) as rn from regions),
 walk(doc_id, page_number, rn, region_type, y1, region_ord) as (
  select doc_id, page_number, rn, region_type, y1, 1 from ranked where rn=1
  union all
  select r.doc_id, r.page_number, r.rn, r.region_type,
   case when r.region_type=w.region_type and abs(r.y0-w.y1)<=0.02::double then greatest(w.y1,r.y1) else r.y1 end,
   case when r.region_type=w.region_type and abs(r.y0-w.y1)<=0.02::double then w.region_ord else w.region_ord+1 end
  from walk w join ranked r on r.doc_id=w.doc_id and r.page_number=w.page_number and r.rn=w.rn+1)""", select="""
 select r.doc_id, r.page_number, w.region_ord, any_value(r.region_type) as region_type, min(r.x0) as x0, min(r.y0) as y0, max(r.x1) as x1,
  max(r.y1) as y1, 1.0::double as confidence, count(*) as n_elements, string_agg(concat(r.doc_id,':',r.pos),'|' order by r.rn) as element_ids
 from ranked r join walk w using (doc_id, page_number, rn) group by r.doc_id, r.page_number, w.region_ord""", recursive=True))
def merge_regions(spark, root):
    merged = layout.merge_regions(layout.classify_regions(derived.elements(spark, root)))
    return merged.withColumn("element_ids", F.array_join("element_ids", "|"))


def _paired_sql(thing, key, cond, limit):
    return f"""paired_{thing} as (
   select f.{key}, f.doc_id, arg_min(c.content, struct_pack(d:=least(abs(c.y0-f.y1),abs(f.y0-c.y1)), p:=c.pos)) as caption,
    min(least(abs(c.y0-f.y1),abs(f.y0-c.y1))) as distance
   from {thing} f join elements c on c.doc_id=f.doc_id and c.page_number=f.page_number and ({cond})
   group by f.{key}, f.doc_id having min(least(abs(c.y0-f.y1),abs(f.y0-c.y1)))<{limit})"""


_FTYPE = """case when regexp_matches(lower(caption),'architecture|framework|system|pipeline|workflow') then 'architecture'
 when regexp_matches(lower(caption),'bar chart|bar graph|histogram') then 'bar_chart'
 when regexp_matches(lower(caption),'line chart|line graph|trend|time series|curve') then 'line_chart'
 when regexp_matches(lower(caption),'scatter|correlation') then 'scatter_plot'
 when regexp_matches(lower(caption),'heatmap|heat map|confusion matrix') then 'heatmap'
 when regexp_matches(lower(caption),'diagram|flowchart|flow chart|schematic') then 'diagram'
 when regexp_matches(lower(caption),'photo|image|micrograph|microscopy') then 'photograph'
 when contains(lower(caption),'table') then 'table_image' end"""
PAIRS = (_paired_sql("figures", "figure_id", "c.element_type='caption' or (contains(lower(substr(c.content,1,15)),'fig') and regexp_matches(substr(c.content,1,20),'[0-9]'))", "0.15::double")
         + ", " + _paired_sql("tables", "table_id", "c.element_type='caption' or regexp_matches(c.content,'(?i)^Table\\s+\\d+')", "1e9::double"))


def captioned_figures(spark, root):
    return layout.pair_figure_captions(derived.figures(spark, root), derived.elements(spark, root))


def captioned_tables(spark, root):
    return layout.pair_table_captions(derived.tables(spark, root), derived.elements(spark, root))


@register("pair_figure_captions", S.query(*S.ENTITY_VIEWS, PAIRS, select=f"""
 select f.figure_id, f.doc_id, f.page_number, p.caption, {_FTYPE} as figure_type
 from figures f left join paired_figures p using (figure_id)"""))
def pair_figure_captions(spark, root):
    return captioned_figures(spark, root).select("figure_id", "doc_id", "page_number", "caption", "figure_type")


@register("pair_table_captions", S.query(*S.ENTITY_VIEWS, PAIRS, select="""
 select t.table_id, t.doc_id, t.page_number, p.caption from tables t left join paired_tables p using (table_id)"""))
def pair_table_captions(spark, root):
    return captioned_tables(spark, root).select("table_id", "doc_id", "page_number", "caption")


_WORDS9 = ["a workflow", "one histogram", "the trend curve", "scatter of", "heat map of", "flow chart", "microscopy", "table of", "nothing"]


@register("figure_type", S.query(*S.DOC_VIEWS, f"""titled as (
  select doc_id, pos, case when pos%10=9 then null else concat('Figure ',pos,' ',{_WORDS9!r}[pos%9+1],' ',content) end as caption from elements)""",
 select=f"select doc_id, pos, {_FTYPE} as figure_type from titled"))
def figure_type(spark, root):
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS9]), (F.col("pos") % 9 + 1).cast("int"))
    caption = F.when(F.col("pos") % 10 != 9, F.concat(F.lit("Figure "), "pos", F.lit(" "), word, F.lit(" "), "content"))
    return derived.elements(spark, root).select("doc_id", "pos", classify.figure_type(caption).alias("figure_type"))


_PREFIX = ["Table {n}: ", "table {n} shows ", "Table {n} ", "Tables {n}. ", "TABLE {n}- ", "Table {n} was "]


def _table_blocks(spark, root):
    """Every element reworded as a possible table caption, with a box in page points."""
    pos = F.col("pos")
    text = F.element_at(
        F.array(*[F.concat(*[F.lit(p.split("{n}")[0]), pos, F.lit(p.split("{n}")[1]), F.col("content")]) for p in _PREFIX]),
        (pos % 6 + 1).cast("int"),
    )
    top = (20 + F.col("reading_order") * 95).cast("double")
    return derived.plain_elements(spark, root).select(
        "doc_id", "page_number", "pos", text.alias("content"), F.lit(72.0).alias("x0"), top.alias("y0"), F.lit(540.0).alias("x1"),
        (top + 12 + pos % 3 * 4).alias("y1"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"),
    )


def _rules(spark, root):
    """Horizontal rules, one per third element; some too short or too thick."""
    pos, order = F.col("pos"), F.col("reading_order")
    top = (30 + order * 90 + pos % 5).cast("double")
    return derived.plain_elements(spark, root).where((F.col("doc_id") + pos) % 3 == 0).where(F.col("page_number") % 3 != 0).select(
        "doc_id", "page_number", (40 + pos % 7 * 20).cast("double").alias("x0"), top.alias("y0"),
        (40 + pos % 7 * 20 + 60 + pos % 11 * 40).cast("double").alias("x1"), (top + pos % 8).alias("y1"),
    )


TABLE_BLOCKS = """tblocks as (
 select doc_id, page_number, pos, concat(['Table ','table ','Table ','Tables ','TABLE ','Table '][pos%6+1], pos, [': ',' shows ',' ','. ','- ',' was '][pos%6+1], content) as content,
  72.0::double as x0, (20+reading_order*95)::double as y0, 540.0::double as x1, (20+reading_order*95)::double + 12 + pos%3*4 as y1,
  612.0::double as page_width, 792.0::double as page_height from elements),
 tcaptions as (
 select *, replace(txt,chr(10),' ') as caption from (select *, """ + S.strip("content") + r""" as txt from tblocks)
 where not regexp_matches(txt,'(?i)^Table\s+\d+\s+(?:shows|compares|presents|reports|displays|lists|gives|illustrates|demonstrates|is|was|were|can|contains|uses)\b')
  and (regexp_matches(txt,'(?i)^Table\s+\d+[:.\-]') or (regexp_matches(txt,'(?i)^Table\s+\d+') and length(txt)<160))),
 rules as (
 select doc_id, page_number, (40+pos%7*20)::double as x0, (30+reading_order*90+pos%5)::double as y0,
  (40+pos%7*20+60+pos%11*40)::double as x1, (30+reading_order*90+pos%5+pos%8)::double as y1
 from elements where (doc_id+pos)%3=0 and page_number%3<>0),
 crops as (
 select c.doc_id, c.page_number, c.pos as caption_pos,
  case when count(r.y0)>0 then greatest(0.0::double, min(r.x0)-10) else 0.0::double end as x0,
  greatest(0.0::double, least(c.y0-10, case when count(r.y0)>0 then min(r.y0)-20 else greatest(0.0::double,c.y0-5) end)) as y0,
  case when count(r.y0)>0 then least(c.page_width, max(r.x1)+10) else c.page_width end as x1,
  least(c.page_height, greatest(case when count(r.y0)>0 then max(r.y1)+15 else least(c.page_height, greatest(0.0::double,c.y0-5)+240) end, c.y1+40)) as y1
 from tcaptions c left join rules r on r.doc_id=c.doc_id and r.page_number=c.page_number and r.x1-r.x0>=80 and r.y1-r.y0<=5
  and (abs(r.y0-c.y0)<350 or abs(r.y0-c.y1)<350)
 group by c.doc_id, c.page_number, c.pos, c.y0, c.y1, c.page_width, c.page_height)"""


@register("table_caption_filter", S.query(*S.DOC_VIEWS, TABLE_BLOCKS, select="select doc_id, pos, caption from tcaptions"))
def table_caption_filter(spark, root):
    return layout.table_captions(_table_blocks(spark, root)).select("doc_id", "pos", "caption")


@register("crop_table_region", S.query(*S.DOC_VIEWS, TABLE_BLOCKS, select="select * from crops"))
def crop_table_region(spark, root):
    return layout.crop_table_regions(layout.table_captions(_table_blocks(spark, root)), _rules(spark, root))


@register("dedupe_crops", S.query(*S.DOC_VIEWS, TABLE_BLOCKS, """numbered as (
  select *, row_number() over (partition by doc_id, page_number order by caption_pos) as rn from crops),
 walk(doc_id, page_number, rn, tops, bottoms, caption_pos, kept) as (
  select doc_id, page_number, rn, [y0], [y1], caption_pos, true from numbered where rn=1
  union all
  select n.doc_id, n.page_number, n.rn,
   case when len(list_filter(range(len(w.tops)), lambda i: abs(w.tops[i+1]-n.y0)<40 and abs(w.bottoms[i+1]-n.y1)<40))>0 then w.tops else list_append(w.tops,n.y0) end,
   case when len(list_filter(range(len(w.tops)), lambda i: abs(w.tops[i+1]-n.y0)<40 and abs(w.bottoms[i+1]-n.y1)<40))>0 then w.bottoms else list_append(w.bottoms,n.y1) end,
   n.caption_pos, len(list_filter(range(len(w.tops)), lambda i: abs(w.tops[i+1]-n.y0)<40 and abs(w.bottoms[i+1]-n.y1)<40))=0
  from walk w join numbered n on n.doc_id=w.doc_id and n.page_number=w.page_number and n.rn=w.rn+1)""", select="""
 select c.* from crops c join walk w using (doc_id, page_number, caption_pos) where w.kept""", recursive=True))
def dedupe_crops(spark, root):
    crops = layout.crop_table_regions(layout.table_captions(_table_blocks(spark, root)), _rules(spark, root))
    return layout.dedupe_crops(crops)


@register("page_elements", S.query(*S.DOC_VIEWS, select="""
 select doc_id, pos, page_number, x0*100 as left_pct, y0*100 as top_pct, (x1-x0)*100 as width_pct, (y1-y0)*100 as height_pct from elements"""))
def page_elements(spark, root):
    return layout.page_elements(derived.elements(spark, root))


_IMAGES = """images as (
 select doc_id, page_number, pos as img_pos, (pos*37+doc_id)%400 as img_width, (pos*53+doc_id)%350 as img_height,
  case when pos%9=4 then null else 40.0::double end as bx0, (reading_order*80)::double as by0,
  40.0::double + (pos*29)%600 as bx1, (reading_order*80)::double + (pos*31)%200 as by1,
  case when pos%23=22 then 0.0::double else 612.0::double end as page_width, 792.0::double as page_height from elements)"""


def _images(spark, root):
    pos, doc = F.col("pos"), F.col("doc_id")
    top = (F.col("reading_order") * 80).cast("double")
    return derived.plain_elements(spark, root).select(
        "doc_id", "page_number", pos.alias("img_pos"), ((pos * 37 + doc) % 400).alias("img_width"), ((pos * 53 + doc) % 350).alias("img_height"),
        F.when(pos % 9 != 4, F.lit(40.0)).alias("bx0"), top.alias("by0"), (F.lit(40.0) + (pos * 29) % 600).alias("bx1"),
        (top + (pos * 31) % 200).alias("by1"), F.when(pos % 23 == 22, 0.0).otherwise(612.0).alias("page_width"), F.lit(792.0).alias("page_height"),
    )


@register("figure_filter", S.query(*S.DOC_VIEWS, _IMAGES, select="""
 select doc_id, page_number, img_pos, concat('fig_p',page_number,'_',row_number() over (partition by doc_id,page_number order by img_pos)) as name,
  greatest(0.0::double,least(1.0::double,bx0/page_width)) as x0, greatest(0.0::double,least(1.0::double,by0/page_height)) as y0,
  greatest(1e-6::double,least(1.0::double,bx1/page_width)) as x1, greatest(1e-6::double,least(1.0::double,by1/page_height)) as y1
 from images where page_width*page_height>0 and img_width>=100 and img_height>=100 and bx0 is not null
  and ((bx1-bx0)*(by1-by0))/(page_width*page_height)>=0.01::double"""))
def figure_filter(spark, root):
    return layout.filter_figures(_images(spark, root))


@register("normalize_bbox", S.query(*S.DOC_VIEWS, _IMAGES, select="""
 select doc_id, img_pos,
  case when page_width>0 then greatest(0.0::double,(bx0-60)/page_width) end as tx0, case when page_width>0 then greatest(0.0::double,by0/page_height) end as ty0,
  case when page_width>0 then least(1.0::double,bx1/page_width) end as tx1, case when page_width>0 then least(1.0::double,by1/page_height) end as ty1,
  case when page_width>0 then greatest(0.0::double,least(1.0::double,(bx0-60)/page_width)) end as rx0,
  case when page_width>0 then greatest(1e-6::double,least(1.0::double,bx1/page_width)) end as rx1
 from images where bx0 is not null"""))
def normalize_bbox(spark, root):
    args = [F.col("bx0") - 60, F.col("by0"), F.col("bx1"), F.col("by1"), F.col("page_width"), F.col("page_height")]
    return (
        _images(spark, root).where("bx0 is not null")
        .withColumn("t", geometry.scale_text_box(*args)).withColumn("r", geometry.scale_region_box(*args))
        .select("doc_id", "img_pos", F.col("t.x0").alias("tx0"), F.col("t.y0").alias("ty0"), F.col("t.x1").alias("tx1"),
                F.col("t.y1").alias("ty1"), F.col("r.x0").alias("rx0"), F.col("r.x1").alias("rx1"))
    )
