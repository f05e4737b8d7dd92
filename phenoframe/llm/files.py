"""Files that tasks write to and read from a folder all executors share."""

from __future__ import annotations

import re
from uuid import uuid4

from pyarrow import fs
from pyspark.taskcontext import TaskContext


def located(url: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file named by URL or path."""
    url = re.sub("^file:/+", "file:///", url)
    return fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), url)


def attempt_name(stem: str) -> str:
    """A file name no other task or attempt uses.

    Only names in a committed manifest count; what a lost attempt has left is never read.
    """
    task = TaskContext.get()
    return f"{stem}-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid4().hex[:8]}"


def write_file(folder: str, name: str, data: bytes) -> None:
    system, path = located(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(data)
