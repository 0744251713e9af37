"""Files in the shared folder, opened from tasks by URI (local, HDFS, object stores)."""

from __future__ import annotations

import uuid


def resolve(uri: str):
    """(filesystem, path) of a folder or file."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("/") else fs.FileSystem.from_uri(uri.replace("file:", "", 1))


def unique_name(prefix: str, suffix: str) -> str:
    """A name no other task attempt uses; only names in a stored manifest are ever read."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"
