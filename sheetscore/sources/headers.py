"""Picture sizes from file headers: a few hundred bytes of each file are read, and none is decoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# The JPEG markers that carry a size (start of frame), and those without a length.
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
BARE = {0x01, 0xD0, 0xD1, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8}
SIZES = "path string, length long, width int, height int, bytes_read long"


class Counted:
    """A file that knows how much of it was read."""

    def __init__(self, file: BinaryIO):
        self.file, self.n = file, 0

    def take(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        self.n += len(data)
        if len(data) < n:
            raise ValueError("the file ends inside its header")
        return data


def _jpeg(file: Counted) -> tuple[int, int]:
    """Segment by segment, each skipped by its length, to the first frame."""
    at = 2
    while True:
        mark, kind = file.take(at, 2)
        if mark != 0xFF:
            raise ValueError("no marker where one is due")
        if kind == 0xFF:  # fill byte
            at += 1
        elif kind in BARE:
            at += 2
        elif kind in FRAMES:
            height, width = struct.unpack(">HH", file.take(at + 5, 4))
            return width, height
        elif kind in (0xD9, 0xDA):
            raise ValueError("no frame before the picture data")
        else:
            at += 2 + struct.unpack(">H", file.take(at + 2, 2))[0]


def picture_size(file: Counted) -> tuple[int, int]:
    """(width, height) by the content's own signature, whatever the file is called; ValueError if it holds none."""
    start = file.take(0, 2)
    if start == b"\xff\xd8":
        size = _jpeg(file)
    elif start == b"\x89P":
        head = file.take(0, 24)
        if head[:16] != b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR":
            raise ValueError("not a picture")
        size = struct.unpack(">II", head[16:])
    else:
        raise ValueError("not a picture")
    if min(size) < 1 or max(size) >= 1 << 31:
        raise ValueError("a picture without a size")
    return size


def _opened(path: str, systems: dict[str, tuple[fs.FileSystem, str]]) -> pa.NativeFile:
    scheme, rest = path.split(":", 1)
    host, name = rest[2:].split("/", 1) if rest.startswith("//") else ("", rest.lstrip("/"))
    base = f"{'s3' if scheme == 's3a' else scheme}://{host}/"
    if base not in systems:
        systems[base] = fs.FileSystem.from_uri(base)
    system, root = systems[base]
    return system.open_input_file(f"{root.rstrip('/')}/{name}")


def header_sizes(files: DataFrame) -> DataFrame:
    """(path, length) -> (path, length, width, height, bytes_read); no row for a file that is no PNG or JPEG.

    Only the header is looked at: a picture that is cut off behind it has its size. A file that cannot be opened fails its task.
    """

    target = to_arrow_schema(T.StructType.fromDDL(SIZES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems: dict[str, tuple[fs.FileSystem, str]] = {}
        for batch in batches:
            rows = []
            for path, length in zip(*(c.to_pylist() for c in batch.columns)):
                with _opened(path, systems) as file:
                    counted = Counted(file)
                    try:
                        width, height = picture_size(counted)
                    except ValueError:
                        continue
                    rows.append({"path": path, "length": length, "width": width, "height": height, "bytes_read": counted.n})
            yield pa.RecordBatch.from_pylist(rows, target)

    return files.select("path", "length").mapInArrow(run, SIZES)
