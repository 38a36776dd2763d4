"""Schemas of the engine's tables, as DDL."""

TABLE = "struct<table_id:string,caption:string,headers:array<string>,rows:array<array<string>>>"
IMAGE = "struct<image_id:string,alt:string,asset_path:string>"
TABLES, IMAGES = f"array<{TABLE}>", f"array<{IMAGE}>"
META = "struct<owner:string,department:string,tags:array<string>,access_roles:array<string>,version:string,last_updated:string>"
RAW_SECTION = f"title:string,level:int,text:string,tables:{TABLES}"
#: A parsed file: one row per file; error is null unless parsing failed.
PARSED = f"path string, doc_id string, title string, source string, format string, sections array<struct<{RAW_SECTION}>>, error string"
RAW_SECTIONS = f"doc_id string, sec_idx int, title string, level int, text string, tables {TABLES}, images {IMAGES}"
KEY_NUMBERS = "doc_id string, kn_idx int, section string, label string, value string, unit string"
EDGES = "doc_id string, from_idx int, to_idx int, edge_type string, weight double"
PDF_LINES = "doc_id string, line_idx int, text string, size double, bold boolean"
ANSWERS = "qid bigint, answer string, citations array<string>, layer_used int, tokens_used int, confidence double"
KEY_NUMBER_WIRE = "struct<label:string,value:string,unit:string,section:string>"
MANIFEST = "udf_version string, doc_id string, title string, source_format string, created_at string, embedding_model string, embedding_dims int, quantization string, section_count int, intelligence boolean, embedding_format string, owner string, department string, tags array<string>, access_roles array<string>, version string, last_updated string, producer string"
CATALOGUE = f"doc_id string, title string, source string, language string, summary string, insights array<string>, owner string, department string, tags array<string>, access_roles array<string>, version string, last_updated string, key_numbers array<{KEY_NUMBER_WIRE}>, section_index array<struct<id:string,title:string,level:int,parent_id:string,children:array<string>,summary:string,keywords:array<string>,token_count:int>>, embedding_model string, embedding_dims int, quantization string"
CONTENT = f"doc_id string, sections map<string,struct<title:string,level:int,text:string,tables:{TABLES},images:{IMAGES}>>"
