from .sink import delete_stream, upsert_stream

__all__ = ["delete_stream", "upsert_stream"]
