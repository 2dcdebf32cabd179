"""Row types of the data model: pages, rows of cells, mappings, selections."""

CELL = "struct<text:string,width_twips:int,align:string,is_merge_first:boolean,is_merge_cont:boolean,colspan:int>"
CELLS = f"array<{CELL}>"
LEXED = f"doc_id string, page_no int, parameter string, rows array<struct<row_no:int,is_header:boolean,cells:{CELLS}>>, error string"
SELECTION = (
    "row_id int, doc_id string, excluded_cols array<int>, excluded_rows array<int>, excluded_header_rows array<int>, "
    "parameters array<string>, timelines array<string>"
)
CONFIG = "row_id int, bookmark string, `table` string"
