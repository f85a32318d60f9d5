"""Quantised images and palettes as rows, text and files."""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import PIECE

#: Bytes of a PNG file's chunks.
CHUNK = 1 << 20


def quantized_pixels(indices: DataFrame, palette: DataFrame) -> DataFrame:
    """(image_id, pos, r, g, b): each pixel in its palette colour. A palette has 256 rows an image at most."""
    p = palette.select("image_id", "palette_idx", "r", "g", "b")
    return indices.join(p, ["image_id", "palette_idx"]).select("image_id", "pos", "r", "g", "b")


def palette_hex(palette: DataFrame) -> DataFrame:
    """(image_id, palette): the colours in hexadecimal, in the palette's order, with a space between."""
    one = F.format_string("%02X%02X%02X", "r", "g", "b")
    ordered = F.array_sort(F.collect_list(F.struct("palette_idx", one.alias("hex"))))
    return palette.groupBy("image_id").agg(F.array_join(F.transform(ordered, lambda x: x["hex"]), " ").alias("palette"))


def points(colors: DataFrame, block: str, least: int = 0) -> DataFrame:
    """Lines `a b l n 0xRRGGBB` for a plot: of rows with components c0 (lightness), c1, c2, a count n and the colour r, g, b; colours of fewer than `least` pixels are left out."""
    line = F.format_string("%s %s %s %d 0x%02X%02X%02X", F.col("c1").cast("string"), F.col("c2").cast("string"), F.col("c0").cast("string"), "n", "r", "g", "b")
    return colors.where(F.col("n") >= least).select(F.lit(block).alias("block"), line.alias("line"))


def png(width: int, height: int, pieces: Iterable[bytes]) -> Iterator[bytes]:
    """A PNG file, part by part, of the bytes r, g, b of its pixels in order, however they are cut. IDAT chunks have CHUNK bytes or more, but for the last."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    yield b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
    deflate, at, held = zlib.compressobj(), 0, b""
    for data in pieces:
        starts = np.arange(-at % (3 * width), len(data), 3 * width)  # a row begins with its filter's number, 0
        held += deflate.compress(np.insert(np.frombuffer(data, np.uint8), starts, 0).tobytes())
        at += len(data)
        if len(held) >= CHUNK:
            yield chunk(b"IDAT", held)
            held = b""
    yield chunk(b"IDAT", held + deflate.flush()) + chunk(b"IEND", b"")


def ppm(width: int, height: int, pieces: Iterable[bytes]) -> Iterator[bytes]:
    yield b"P6\n%d %d\n255\n" % (width, height)
    yield from pieces


ENCODE = {"png": png, "ppm": ppm}


def packed_pixels(pixels: DataFrame) -> DataFrame:
    """(image_id, place, part, data): pixels as bytes r, g, b, about PIECE of them a row. By place (of positions) and part they are in order. Python holds
    a piece and a batch, however many pixels an image or a place has."""

    def pack(batches):
        key, part, held, size = None, 0, [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((key[0], pa.int64()), (key[1], pa.int64()), (part, pa.int64()), (b"".join(held), pa.binary()))], names=["image_id", "place", "part", "data"])

        for b in batches:
            if not b.num_rows:
                continue
            ids, places = b.column("image_id").to_numpy(), b.column("place").to_numpy()
            rgb = b.column("rgb").to_numpy().astype(">i4").view(np.uint8).reshape(-1, 4)[:, 1:]
            cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(places) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                if (now := (int(ids[lo]), int(places[lo]))) != key:
                    if held:
                        yield row()
                    key, part, held, size = now, 0, [], 0
                held.append(rgb[lo:hi].tobytes())
                size += hi - lo
                if size >= PIECE:
                    yield row()
                    part, held, size = part + 1, [], 0
        if held:
            yield row()

    r, g, b = (F.col(c).cast("int").bitwiseAND(255) for c in "rgb")
    place = F.coalesce(F.expr(f"CAST(pos AS BIGINT) DIV {PIECE}"), F.lit(1 << 62))  # pixels without a position come last
    small = pixels.where("image_id is not null").select("image_id", place.alias("place"), "pos", (F.shiftleft(r, 16) + F.shiftleft(g, 8) + b).alias("rgb"))
    dealt = small.repartition("image_id", "place").sortWithinPartitions("image_id", "place", "pos", "rgb")
    return dealt.select("image_id", "place", "rgb").mapInArrow(pack, "image_id long, place long, part long, data binary")


def ordered_pieces(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, width, height, data): packed pixels, an image's in one partition and in order."""
    sized = packed_pixels(pixels).join(images.select("image_id", "width", "height"), "image_id")
    return sized.repartition("image_id").sortWithinPartitions("image_id", "place", "part").select("image_id", "width", "height", "data")


def files(rows: Iterable[tuple], encode: Callable) -> Iterator[tuple[int, int, int, Iterator[bytes]]]:
    """(image_id, width, height, the file part by part) of each image, from rows of ordered_pieces. A file is read to its end before the next is asked for."""

    def whole(w: int, h: int, pieces: Iterable[tuple]) -> Iterator[bytes]:
        n = 0
        for *_, data in pieces:
            n += len(data) // 3
            if n <= w * h:
                yield data
        if n != w * h:
            raise ValueError(f"an image of {w} x {h} has {n} pixels")

    for (i, w, h), pieces in itertools.groupby(rows, lambda r: tuple(r[:3])):
        yield i, w, h, encode(w, h, whole(w, h, pieces))


def image_bytes(pixels: DataFrame, images: DataFrame, kind: str = "png") -> DataFrame:
    """(image_id, width, height, content): each image as the bytes of a file. images has image_id, width, height; one image is made in one task, piece by
    piece, and only its file is held whole, as it is one value."""
    encode = ENCODE[kind]

    def build(batches):
        rows = ((*(b.column(c)[i].as_py() for c in ("image_id", "width", "height")), b.column("data")[i].as_buffer()) for b in batches for i in range(b.num_rows))
        for i, w, h, parts in files(rows, encode):
            out = pa.BufferOutputStream()
            for x in parts:
                out.write(x)
            content = out.getvalue()
            one = pa.Array.from_buffers(pa.binary(), 1, [None, pa.array([0, content.size], pa.int32()).buffers()[1], content])
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (i, w, h)), one], names=["image_id", "width", "height", "content"])

    return ordered_pieces(pixels, images).mapInArrow(build, "image_id long, width long, height long, content binary")


def write_image_files(pixels: DataFrame, images: DataFrame, folder: str, kind: str = "png") -> None:
    """The images as files <image_id>.<kind> in a folder that all machines share (an absolute path, or a URI of pyarrow's file systems). A file is written piece
    by piece, and under another name first, so that a task that is run again leaves whole files."""
    encode = ENCODE[kind]

    def save(rows) -> None:
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for i, _, _, parts in files(rows, encode):
            part = f"{root}/.{i}-{uuid.uuid4()}"
            try:
                with system.open_output_stream(part) as out:
                    for x in parts:
                        out.write(x)
            except BaseException:
                system.delete_file(part)
                raise
            system.move(part, f"{root}/{i}.{kind}")

    ordered_pieces(pixels, images).foreachPartition(save)


def write_images(pixels: DataFrame, images: DataFrame, path: str, kind: str = "png") -> None:
    """The images as rows of a Parquet table (image_id, width, height, content) at path."""
    image_bytes(pixels, images, kind).write.mode("overwrite").parquet(path)
