from .inspect import Inspect

__all__ = ["Inspect"]
