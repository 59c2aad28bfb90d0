import io
import struct
import zlib

import numpy as np
import pytest

from sheetscore.sources import headers, readers


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(width, height, extra=b""):
    rows = zlib.compress((b"\0" + bytes(width)) * height)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + extra + chunk(b"IDAT", rows) + chunk(b"IEND", b"")


def segment(kind, data):
    return bytes([0xFF, kind]) + struct.pack(">H", len(data) + 2) + data


def jpeg(width, height, frame=0xC0, before=b""):
    return b"\xff\xd8" + before + segment(frame, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00") + segment(0xDA, bytes(6)) + bytes(200_000)


THUMB = segment(0xE1, b"Exif\0\0" + jpeg(160, 120)[:60_000])  # a size inside a segment is not the picture's
GOOD = {
    "a.png": (png(37, 11), (37, 11)),
    "b c%20+.PNG": (png(1, 2, chunk(b"tEXt", b"x" * 300_000)), (1, 2)),
    "c.jpg": (jpeg(640, 480), (640, 480)),
    "d.jpeg": (jpeg(65535, 3, 0xC2, THUMB * 5 + b"\xff\xff" + segment(0xC4, bytes(40)) + b"\xff\x01"), (65535, 3)),
    "png.named.jpg": (png(5, 6), (5, 6)),
    "cut.png": (png(9, 8)[:30], (9, 8)),
}
BAD = {
    "e.png": b"", "f.jpg": b"\xff", "g.jpg": jpeg(4, 4)[:9], "h.jpg": b"\xff\xd8" + segment(0xDA, bytes(6)), "i.png": b"\x89PNG" + bytes(40),
    "j.jpg": b"no picture at all", "k.jpg": jpeg(0, 4), "l.jpg": b"\xff\xd8" + segment(0xE0, bytes(9))[:-3], "m.png": png(3, 0), "n.txt": png(3, 3),
}


def test_sizes_from_headers(spark, tmp_path):
    for name, data in [*((n, d) for n, (d, _) in GOOD.items()), *BAD.items()]:
        (tmp_path / name).write_bytes(data)
    rows = readers.read_image_sizes(spark, str(tmp_path)).collect()
    assert {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in rows} == {n: size for n, (_, size) in GOOD.items()}
    assert {r.image for r in rows} == {n.rsplit(".", 1)[0] for n in GOOD}
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    assert all(r.bytes_read < 1000 for r in headers.header_sizes(files).collect())
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()
    assert headers.header_sizes(files.limit(0)).count() == 0


def test_same_sizes_as_the_decoder(spark, tmp_path):
    r = np.random.default_rng(3)
    for i in range(20):
        (tmp_path / f"{i}.png").write_bytes(png(int(r.integers(1, 400)), int(r.integers(1, 400))))
    decoded = spark.read.format("image").load(str(tmp_path)).selectExpr("image.origin AS path", "image.width", "image.height")
    name = lambda path: path.rsplit("/", 1)[1]
    assert {(name(x.path), x.width, x.height) for x in decoded.collect()} == {
        (name(x.path), x.width, x.height) for x in readers.read_image_sizes(spark, str(tmp_path)).collect()
    }


def test_a_segment_may_be_shorter_than_its_length_field():
    with pytest.raises(ValueError):
        headers.picture_size(headers.Counted(io.BytesIO(b"\xff\xd8" + b"\xff\xe0\x00\x00" * 5)))
