"""Helpers shared by the corpus operators: shared storage, table loading, joins that hold against hot keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions.frames import in_arrow, table
from foliospark.functions.joins import HOT_PARTS, hot_join, hot_keys
from foliospark.functions.storage import open_fs, remove, scratch, shared_dir, write, written

__all__ = ["HOT_PARTS", "hot_join", "hot_keys", "in_arrow", "open_fs", "remove", "scratch", "shared_dir", "table", "text_or_empty", "write", "written"]


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
