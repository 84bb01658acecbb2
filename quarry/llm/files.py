"""Small files in the shared folder, written and read by tasks through Arrow's file systems.

A write goes to a name of its own and is then moved into place, so a task that runs twice, after a
lost executor or speculatively, leaves one whole file with the same content.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """Hadoop writes local folders as file:/x; Arrow wants file:///x."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def place(uri: str, name: str, write: Callable[[pa.NativeFile], None]) -> None:
    """Writes uri/name by way of a temporary name in the same folder."""
    store, folder = opened(uri)
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        write(out)
    store.move(part, f"{folder}/{name}")


def write_blobs(blobs: DataFrame, uri: str) -> None:
    """Each row (name, data) as the file uri/name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                place(uri, str(name.as_py()), lambda out, d=data: out.write(d.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    blobs.mapInArrow(run, "n long").agg({"n": "sum"}).collect()


def open_table(uri: str) -> Callable[[int], bytes | None]:
    """Reads uri/name, None where there is no such file."""
    store, folder = opened(uri)

    def read(name: int) -> bytes | None:
        path = f"{folder}/{name}"
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with store.open_input_stream(path) as f:
            return f.read()

    return read
