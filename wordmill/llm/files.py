"""Files that executors write and read below the shared folder, by URI.

Any store that Arrow knows (local or mounted folders, HDFS, S3, GCS) will do. A file
appears under its final name only when it is whole.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"/{uri}")


class TemporaryFile:
    """Written under a temporary name; ``commit`` gives it its final name."""

    def __init__(self, folder: str, name: str, attempt: str) -> None:
        self._fs, base = _open(folder)
        self._fs.create_dir(base, recursive=True)
        self._temporary = f"{base}/_tmp-{name}-{attempt}"
        self._final = f"{base}/{name}"
        self.uri = f"{folder}/{name}"
        self._stream = self._fs.open_output_stream(self._temporary, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self._stream.write(data)
        self.size += len(data)

    def commit(self) -> None:
        """An earlier attempt's file of that name is replaced."""
        self._stream.close()
        if self._fs.get_file_info(self._final).type == fs.FileType.File:
            self._fs.delete_file(self._final)
        self._fs.move(self._temporary, self._final)

    def abandon(self) -> None:
        self._stream.close()
        self._fs.delete_file(self._temporary)


@contextmanager
def reading(uri: str):
    """A random-access file."""
    found, path = _open(uri)
    with found.open_input_file(path) as f:
        yield f
