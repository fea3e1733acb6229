from .batch import Batch, SyncBatch
from .table import AlreadyExists, NotFound, Table

__all__ = ["AlreadyExists", "Batch", "NotFound", "SyncBatch", "Table"]
