"""Project thumbnails: format, size and dimension checks on image bytes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits, signatures and extensions.
MAX_BYTES = 1 << 20
MIN_PIXELS, MAX_PIXELS = 100, 3000
PNG_SIGNATURE, JPEG_SIGNATURE = "89504E470D0A1A0A", "FFD8FF"
EXTENSIONS = {"image/png": ".png", "image/jpeg": ".jpg"}
TYPE_OF_EXTENSION = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}


def content_type(content: Column) -> Column:
    """image/png or image/jpeg by the first bytes, else NULL."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == PNG_SIGNATURE, "image/png").when(head.startswith(JPEG_SIGNATURE), "image/jpeg")


# The bit depths that each PNG colour type allows, and the component counts of a JPEG frame.
PNG_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
JPEG_COMPONENTS = (1, 3, 4)


def _number(content: Column, start: int, length: int) -> Column:
    return F.conv(F.hex(F.substring(content, start, length)), 16, 10).cast("bigint")


def png_size(content: Column) -> Column:
    """STRUCT(width, height) from a PNG's header; NULL when the header chunk is damaged or names no valid format."""
    header = F.substring(content, 13, 17)
    formats = [f"{depth:02X}{colour:02X}0000{interlace:02X}" for colour, depths in PNG_DEPTHS.items() for depth in depths for interlace in (0, 1)]
    good = (
        (F.length(header) == 17)
        & (F.hex(F.substring(content, 9, 8)) == "0000000D49484452")
        & (F.crc32(header) == _number(content, 30, 4))
        & F.hex(F.substring(content, 25, 5)).isin(formats)
        & (_number(content, 17, 4) > 0)
        & (_number(content, 21, 4) > 0)
    )
    return F.when(good, F.struct(_number(content, 17, 4).alias("width"), _number(content, 21, 4).alias("height")))


def jpeg_header_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the first frame header of a JPEG, None without a readable one of 8 bits."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        if marker == 0x00 or 0xD0 <= marker <= 0xD7:  # no segment follows
            at += 2
            continue
        if marker in (0xD9, 0xDA):  # end, or pixels before any frame header
            return None
        (length,) = struct.unpack_from(">H", data, at + 2)
        if marker in (0xC0, 0xC1, 0xC2):
            if length < 8 or at + 2 + length > len(data):
                return None
            precision, height, width, components = struct.unpack_from(">BHHB", data, at + 4)
            if precision != 8 or components not in JPEG_COMPONENTS or length != 8 + 3 * components:
                return None
            return width, height
        at += 2 + length
    return None


@F.pandas_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def _jpeg_size(contents: pd.Series) -> pd.DataFrame:
    """Sizes of a batch of JPEGs; NULL in, NULL out."""
    sizes = [(None if data is None else jpeg_header_size(data)) or (None, None) for data in contents]
    return pd.DataFrame(sizes, columns=["width", "height"], dtype="Int64")


def validate_images(images: DataFrame, column: str = "content") -> DataFrame:
    """Add ``extension, width, height, error_type`` to rows with image bytes.

    First error in order: empty, limit_exceeded, invalid_format (neither PNG nor
    JPEG by content), invalid_data (unreadable header), too_small, too_large.
    PNG headers are read by expressions. JPEG headers need a walk over segments:
    the bytes of JPEGs within the size limit go to Python, nothing for other
    rows, and nothing is shuffled.
    """
    content = F.col(column)
    kind = content_type(content)
    length = F.coalesce(F.length(content), F.lit(0))
    early = F.when(length == 0, "empty").when(length > MAX_BYTES, "limit_exceeded").when(kind.isNull(), "invalid_format")
    good = early.isNull()
    checked = images.withColumns(
        {
            "_kind": kind,
            "_early": early,
            "_png": F.when(good & (kind == "image/png"), png_size(content)),
            "_jpeg": _jpeg_size(F.when(good & (kind == "image/jpeg"), content)),
        }
    )
    width = F.coalesce("_png.width", "_jpeg.width")
    height = F.coalesce("_png.height", "_jpeg.height")
    error = F.coalesce(
        "_early",
        F.when(width.isNull(), "invalid_data")
        .when((width < MIN_PIXELS) | (height < MIN_PIXELS), "too_small")
        .when((width > MAX_PIXELS) | (height > MAX_PIXELS), "too_large"),
    )
    extensions = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    extension = F.when(error.isNull(), F.try_element_at(extensions, F.col("_kind")))
    out = checked.withColumns({"error_type": error, "extension": extension, "width": width, "height": height})
    return out.drop("_kind", "_early", "_png", "_jpeg")


def pick_images(images: DataFrame) -> DataFrame:
    """One image per project, the first by path: ``project, path, content_type``.

    The type comes from the extension, else from the content. Only the short
    type text is sorted and aggregated, not the image.
    """
    known = F.create_map(*[F.lit(x) for pair in TYPE_OF_EXTENSION.items() for x in pair])
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.coalesce(F.try_element_at(known, extension), content_type(F.col("content")), F.lit("application/octet-stream"))
    typed = images.select("project", "path", kind.alias("_kind"))
    return typed.groupBy("project").agg(F.min("path").alias("path"), F.min_by("_kind", "path").alias("content_type"))
