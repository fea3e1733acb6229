from .catalog import Catalog

__all__ = ["Catalog"]
