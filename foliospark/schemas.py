"""Row types. ``ord`` is the place of a row in its document: data frames have no order of their own."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "ints": T.ArrayType(T.IntegerType())}
_KINDS["box"] = T.StructType([T.StructField(k, T.DoubleType()) for k in ("x1", "y1", "x2", "y2")])
_KINDS["size"] = T.StructType([T.StructField(k, T.DoubleType()) for k in ("w", "h")])


def _row(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split(":") for c in columns.split())])


ELEMENT = _row(
    "doc_id:string file_name:string source_path:string ord:int element_index:int page_number:int type:string text:string html:string image_path:string"
    " coordinates:box layout:size given_box:box is_toc:boolean"
)

CHUNK = _row(
    "doc_id:string chunk_id:string ord:int source_file:string page_start:int page_end:int role:string text:string html:string image_path:string bbox:box"
    " coord_system:string page_width:double page_height:double bbox_abs:box source_element_ids:ints prev_id:string next_id:string order_rank:int"
    " section_id:string section_path:string section_level:int section_index:int schema_version:string content_sha256:string"
)

ROLES = ("title", "h1", "h2", "h3", "paragraph", "list_item", "caption", "table", "figure", "other")
VERSION = "1.0"

#: Chunks that are embedded unless another policy is given.
EMBED_POLICY = "roles=title,h1,h2,h3,paragraph,list_item,caption,table|min_len=15|skip_empty_figures"
