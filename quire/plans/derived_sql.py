"""The derived views as SQL text, for the independent check of every query."""

from __future__ import annotations

LINES = """lines as (
 select doc_id, len(string_split(text, chr(10))) as n_lines,
        unnest(range(len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as line
 from documents)"""

BODY = """body as (
 select doc_id, pos, cast(floor(pos/8) as int)+1 as page_number, cast(pos%8 as int) as reading_order,
  case when pos=0 then 'title' when pos%7=1 then 'heading' when pos%13=6 then 'equation' when pos%17=9 then 'caption' else 'paragraph' end as element_type,
  case when pos=0 then line
   when pos%7=1 then concat(cast(cast(floor(pos/7) as int)+1 as varchar),'. ',line)
   when pos%13=6 then concat(line,' α_{',cast(pos as varchar),'} = ∑ f(x) + x^2 (',cast(pos as varchar),')')
   when pos%17=9 then concat('Figure ',cast(pos as varchar),': ',line)
   when (doc_id+pos)%3=0 then concat(line,' [',cast((doc_id+pos)%4+1 as varchar),']')
   when (doc_id+pos)%5=1 then concat(line,' Okafor et al. (20',cast(10+pos%10 as varchar),')')
   when (doc_id+pos)%7=2 then concat(line,' (Lindqvist, 2019) [1, 3]')
   else line end as content
 from lines where length(trim(line))>0)"""

BIBLIOGRAPHY = """bibliography as (
 select doc_id, n_lines+i as pos, cast(floor((n_lines+i)/8) as int)+1 as page_number, cast((n_lines+i)%8 as int) as reading_order,
  case when i=0 then 'references' else 'paragraph' end as element_type,
  case when i=0 then 'References' else concat('[',cast(i as varchar),'] ',
   case when (doc_id+i)%3=0 then 'Okafor and Lindqvist' when (doc_id+i)%3=1 then 'Marchetti' else 'Lindqvist' end,
   '. A study of topic ',cast((doc_id*7+i*3)%50 as varchar),'. Journal of Tests, ',cast(1990+(doc_id+i)%30 as varchar),
   '. doi:10.1234/t',cast((doc_id*7+i*3)%50 as varchar)) end as content
 from (select distinct doc_id, n_lines from lines) d, range(4) r(i) where i<=2+doc_id%2)"""

ELEMENTS = """elements as (
 select *, 0.1::double as x0, (2+reading_order*12)::double/100 as y0, 0.9::double as x1,
  case when pos%3=0 then (2+reading_order*12)::double/100 + 0.07::double else (2+reading_order*12)::double/100 + 0.11::double end as y1,
  case when element_type='title' then 20.0::double when element_type='heading' then 14.0::double when pos%16=0 then 8.0::double else 10.0::double end as font_size,
  element_type in ('title','heading') as is_bold
 from (select * from body union all select * from bibliography))"""

CAPTIONED = """captioned as (select distinct doc_id, page_number from body where element_type='caption')"""

FIGURES = """figures as (
 select doc_id, page_number::bigint as pos, page_number, concat('f',doc_id,'-',page_number) as figure_id, 0.1::double as x0,
  (20+(doc_id+page_number)%3*20)::double/100 as y0, 0.9::double as x1, (20+(doc_id+page_number)%3*20)::double/100+0.15::double as y1
 from captioned)"""

TABLES = """tables as (
 select doc_id, page_number::bigint as pos, page_number, concat('t',doc_id,'-',page_number) as table_id, 0.1::double as x0,
  (20+(doc_id+page_number)%3*20)::double/100 as y0, 0.9::double as x1, (20+(doc_id+page_number)%3*20)::double/100+0.15::double as y1,
  (2+doc_id%3)::int as "rows", 3 as cols
 from captioned where page_number%2=0)"""

META = """meta as (
 select doc_id, nullif(trim(string_split(text,chr(10))[1]),'') as title, concat('Author A',floor(doc_id/5)::int) as author_a,
  concat('Author B',floor(doc_id/7)::int) as author_b, floor((len(string_split(text,chr(10)))+2+doc_id%2)/8)::int+1 as page_count,
  concat('doc_',doc_id,'.pdf') as filename, source, lang, n_chars
 from documents)"""

WORDS = """words as (
 select doc_id, page_number, 1 as block_num, 1 as par_num, pos as line_num, k as word_num, word as text,
  (40+k*60)::double as "left", (40+pos*14+k%2)::double as top, (6*length(word))::double as width, 10.0::double as height,
  case when k%11=10 then -1.0::double else (50+(k*7+doc_id)%50)::double end as conf
 from (select doc_id, pos, page_number, unnest(range(len(string_split(content,' ')))) as k, unnest(string_split(content,' ')) as word from body))"""

QUESTIONS = """questions as (
 select item_id as query_id, concat(['summarize','table','figure','equation','citation','compare','the results',''][item_id%8+1],' ',text) as query
 from benchmark)"""

ANSWERS = """answers as (
 select item_id as query_id,
  case when item_id%5=0 then text else concat('Based on [Source ',item_id%4+1,'] and [source',item_id%3+2,'] ',text) end as answer,
  concat('text {"overall_decision": "ACCEPT", "soundness_score": ',item_id%10, case when item_id%6=0 then ' tail' else '} tail' end) as reply
 from benchmark)"""

# Whitespace removed by strip(), written for the checking engine.
STRIP_CHARS = (
    "' '||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)||chr(28)||chr(29)||chr(30)||chr(31)||chr(133)||chr(160)||chr(5760)"
    "||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)"
    "||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
)


def strip(expr: str) -> str:
    return f"trim({expr}, {STRIP_CHARS})"


def tokens(expr: str) -> str:
    return f"(case when length({expr})=0 then 0 else greatest(1, floor(length({expr})/4)::int) end)"


def query(*ctes: str, select: str, recursive: bool = False) -> str:
    head = "with recursive " if recursive else "with "
    return head + ",\n".join(ctes) + "\n" + select


DOC_VIEWS = (LINES, BODY, BIBLIOGRAPHY, ELEMENTS)
ENTITY_VIEWS = (*DOC_VIEWS, CAPTIONED, FIGURES, TABLES)
