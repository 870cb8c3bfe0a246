"""Table schemas. Nothing is inferred while reading."""

from __future__ import annotations

HISTORY = "array<struct<type:string,commit:string>>"

RAW_FRAGMENT_TEXT = (
    "clone_id string, index int, file_path string, start_line int, end_line int, "
    "start_column int, end_column int, modification string"
)
ENRICHED_TEXT = (
    "clone_id string, fragment_index int, file_path string, file_id int, service string, start_line int, "
    "end_line int, line_count int, file_type string, modified_commits string, modified_count int"
)
PAIR_COLUMNS = {
    "clone_id": "string", "file_path_x": "string", "file_path_y": "string", "file_id_x": "bigint", "file_id_y": "bigint",
    "start_line_x": "int", "end_line_x": "int", "start_line_y": "int", "end_line_y": "int", "service_x": "string",
    "service_y": "string", "relation": "string", "comodified": "string", "comodified_commits": "string",
    "comodification_count": "bigint", "file_type_x": "string", "file_type_y": "string", "token_count": "int",
    "clone_type": "string",
}
SNAPSHOT = (
    "file_data array<struct<file_id:int,file_path:string,loc:int,token_count:int>>, "
    "clone_sets array<struct<clone_id:int,token_count:int,fragments:"
    "array<struct<file_id:int,start_line:int,end_line:int,start_col:int,end_col:int>>>>"
)
LANGUAGE_STATS = (
    "map<string,struct<services:map<string,struct<file_count:int,total_loc:int>>,total_files:int,total_loc:int,"
    "unresolved_files:int,unresolved_loc:int,file_ranges:map<string,array<array<int>>>>>"
)
SERVICES = (
    "URL string, services map<string,array<string>>, languages map<string,map<string,array<string>>>, "
    f"language_stats {LANGUAGE_STATS}"
)
HUNK = (
    "child_path string, parent_path string, inserted_lines array<int>, deleted_lines array<int>, modified_lines array<int>"
)
_END = "struct<clone_id:int,index:int,file_id:int,file_path:string,start_line:int,end_line:int>"
TRANSITION = f"clone_id int, fragments array<struct<type:string,parent:{_END},child:{_END}>>"
DATASET = "URL string, languages map<string,map<string,array<string>>>"
GOLD = "id string, file_path string, language string, file_text string, label string, rationale string"
RUN_PARAMETERS = (
    "project string, detection_method string, min_tokens int, import_filter boolean, comod_method string, "
    "analysis_method string, analysis_frequency int, search_depth int, max_analyzed_commits int"
)
