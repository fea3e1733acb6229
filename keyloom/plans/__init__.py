from .query import Query
from .schema import IndexDef, Sort, TableDef, asc, desc
from .selector import Point, Points, Range, Ranges

__all__ = ["IndexDef", "Point", "Points", "Query", "Range", "Ranges", "Sort", "TableDef", "asc", "desc"]
