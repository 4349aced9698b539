"""Files in the shared folder, written by Python tasks so that retries leave one whole file."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable


def filesystem(path: str):
    """The file system of a URI or path, and the path in it."""
    from pyarrow import fs

    # Spark's names of S3 are not known to Arrow.
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def write_file(path: str, write: Callable) -> None:
    """Writes aside and renames: a lost or speculative attempt never leaves part of a file."""
    files, at = filesystem(path)
    files.create_dir(at.rpartition("/")[0], recursive=True)
    aside = f"{at}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(aside, compression=None) as out:
        write(out)
    files.move(aside, at)
