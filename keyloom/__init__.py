"""Typed, indexed tables on Spark."""

from .functions import cond
from .operators import AlreadyExists, Batch, NotFound, SyncBatch, Table
from .plans import IndexDef, Point, Points, Query, Range, Ranges, Sort, TableDef, asc, desc
from .sources import Catalog

__all__ = ["AlreadyExists", "Batch", "Catalog", "IndexDef", "NotFound", "Point", "Points", "Query", "Range", "Ranges", "Sort", "SyncBatch", "Table", "TableDef", "asc", "cond", "desc"]
