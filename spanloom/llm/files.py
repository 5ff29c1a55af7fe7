"""Files that tasks write to and read from the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import TaskContext


def open_uri(uri: str):
    """(file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def into_place(folder: str, name: str, write: Callable) -> None:
    """Writes a file under a name of this attempt and moves it to its own."""
    files, path = open_uri(folder)
    files.create_dir(path, recursive=True)
    context = TaskContext.get()
    mine = f"{path}/.{name}.{context.taskAttemptId() if context else 0}"
    with files.open_output_stream(mine) as out:
        write(out)
    try:
        files.move(mine, f"{path}/{name}")
    except OSError:  # not every store lets a file be replaced; another attempt's is the same
        if files.get_file_info(f"{path}/{name}").type.name != "File":
            raise
        files.delete_file(mine)
