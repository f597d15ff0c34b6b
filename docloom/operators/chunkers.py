"""All chunkers by name. Importing this module registers those that live in modules of their own."""

from __future__ import annotations

from docloom.operators import semantic, splitting  # noqa: F401
from docloom.operators.chunking import chunk_by_name, chunker_named, register_chunker, without_chunk

__all__ = ["chunk_by_name", "chunker_named", "register_chunker", "without_chunk"]
