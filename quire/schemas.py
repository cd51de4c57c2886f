"""Schemas of persisted documents."""

from __future__ import annotations

BOX = "struct<x0:double,y0:double,x1:double,y1:double,page:int>"
METADATA = (
    "struct<title:string,authors:array<string>,abstract:string,keywords:array<string>,publication_year:int,venue:string,"
    "doi:string,arxiv_id:string,page_count:int,language:string,document_type:string,file_size_bytes:bigint,"
    "has_toc:boolean,has_references:boolean,is_scanned:boolean>"
)
ELEMENT = (
    f"struct<id:string,element_type:string,content:string,page_number:int,bounding_box:{BOX},confidence:double,level:int,"
    "font_size:double,font_name:string,is_bold:boolean,is_italic:boolean,reading_order:int,metadata:map<string,string>>"
)
CELL = "struct<row:int,col:int,row_span:int,col_span:int,content:string,is_header:boolean>"
TABLE = (
    f"struct<id:string,page_number:int,bounding_box:{BOX},rows:int,cols:int,cells:array<{CELL}>,caption:string,"
    "image_path:string,csv_repr:string,summary:string>"
)
FIGURE = (
    f"struct<id:string,page_number:int,bounding_box:{BOX},image_path:string,caption:string,description:string,figure_type:string>"
)
EQUATION = (
    f"struct<id:string,page_number:int,bounding_box:{BOX},raw_text:string,latex:string,is_inline:boolean,"
    "variables:array<string>,explanation:string>"
)
CITATION = "struct<id:string,cite_key:string,page_number:int,context:string,reference_id:string>"
REFERENCE = (
    "struct<id:string,index:bigint,raw_text:string,authors:array<string>,title:string,venue:string,year:int,doi:string,url:string>"
)
CHUNK = (
    f"struct<id:string,doc_id:string,chunk_type:string,content:string,page_number:int,section:string,section_level:int,"
    f"bounding_box:{BOX},element_ids:array<string>,token_count:int,metadata:map<string,string>,embedding:array<double>>"
)
STATS = (
    "struct<total_pages:int,ocr_pages:int,digital_pages:int,elements_detected:int,tables_found:int,figures_found:int,"
    "equations_found:int,citations_found:int,references_found:int,chunks_created:int,embeddings_created:int,"
    "processing_time_seconds:double,ocr_mean_confidence:double>"
)
CHILDREN = {
    "elements": ELEMENT, "tables": TABLE, "figures": FIGURE, "equations": EQUATION, "citations": CITATION,
    "references": REFERENCE, "chunks": CHUNK,
}
DOCUMENT = (
    f"id string, filename string, file_path string, pipeline_type string, status string, metadata {METADATA}, "
    + ", ".join(f"`{name}` array<{kind}>" for name, kind in CHILDREN.items())
    + f", stats {STATS}, error_message string, created_at string, updated_at string"
)
