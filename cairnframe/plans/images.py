"""Image queries: the bytes are built from the part table by expressions."""

from pyspark.sql import functions as F

from ..operators import images as im
from .registry import query

# Kind of image a part stands for, and its dimensions, in either engine.
_KIND = "CASE WHEN p_partkey % 8 = 7 AND p_size < 45 THEN 0 ELSE p_partkey % 8 END"
_WIDTH, _HEIGHT = "CAST(p_size * 70 AS BIGINT)", "CAST(p_size * 3 + 60 AS BIGINT)"


def _hex(value, digits):
    return F.lpad(F.hex(value), digits, "0")


def _with_content(part):
    """0, 1: PNG; 2, 3: JPEG; 4: text; 5: empty; 6: PNG with a wrong checksum; 7: too many bytes."""
    kind = F.expr(_KIND)
    part = part.withColumn("w", F.expr(_WIDTH)).withColumn("h", F.expr(_HEIGHT))
    header = F.concat(F.lit("49484452"), _hex("w", 8), _hex("h", 8), F.lit("0802000000"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D"), header)
    good = F.concat(png, _hex(F.crc32(F.unhex(header)), 8))
    jfif = "FFD8FFE000104A46494600010100000100010000"
    jpeg = F.concat(F.lit(jfif + "FFFFC0001108"), _hex("h", 4), _hex("w", 4), F.lit("03012200021101031101FFD9"))
    text = (
        F.when(kind <= 1, good)
        .when(kind <= 3, jpeg)
        .when(kind == 4, F.hex("p_name"))
        .when(kind == 5, "")
        .when(kind == 6, F.concat(png, F.lit("00000000")))
        .otherwise(F.concat(good, F.repeat(F.lit("00"), im.MAX_BYTES)))
    )
    return part.withColumn("content", F.unhex(text))


def _images(t):
    return _with_content(t["part"]).select("p_partkey", "content")


@query(
    "i_images",
    f"""
WITH s AS (SELECT p_partkey, {_KIND} AS kind, {_WIDTH} AS w, {_HEIGHT} AS h FROM part),
e AS (SELECT *, CASE kind WHEN 4 THEN 'invalid_format' WHEN 5 THEN 'empty' WHEN 6 THEN 'invalid_data' WHEN 7 THEN 'limit_exceeded'
  ELSE CASE WHEN w < 100 OR h < 100 THEN 'too_small' WHEN w > 3000 OR h > 3000 THEN 'too_large' END END AS error_type FROM s)
SELECT p_partkey, error_type, CASE WHEN kind <= 3 THEN w END AS width, CASE WHEN kind <= 3 THEN h END AS height,
  CASE WHEN error_type IS NULL THEN CASE WHEN kind <= 1 THEN '.png' ELSE '.jpg' END END AS extension FROM e
""",
)
def i_images(t):
    checked = im.validate_images(_images(t))
    return checked.select("p_partkey", "error_type", "width", "height", "extension")


@query(
    "i_pick",
    f"""
WITH f AS (SELECT p_brand AS project, concat(p_brand, '/thumbnail.', CASE WHEN p_size % 3 = 0 THEN 'png' WHEN p_size % 3 = 1 THEN 'jpeg' ELSE 'bin' || p_partkey END) AS path, {_KIND} AS kind, p_partkey FROM part),
m AS (SELECT project, min(path) AS path FROM f GROUP BY project)
SELECT m.project, m.path, CASE WHEN m.path LIKE '%.png' THEN 'image/png' WHEN m.path LIKE '%.jpeg' THEN 'image/jpeg'
  WHEN any_value(f.kind) IN (0, 1, 6, 7) THEN 'image/png' WHEN any_value(f.kind) IN (2, 3) THEN 'image/jpeg' ELSE 'application/octet-stream' END AS content_type
FROM m JOIN f ON f.project = m.project AND f.path = m.path GROUP BY m.project, m.path
""",
)
def i_pick(t):
    size = F.col("p_size") % 3
    name = F.when(size == 0, "png").when(size == 1, "jpeg").otherwise(F.concat(F.lit("bin"), F.col("p_partkey").cast("string")))
    named = t["part"].select("p_partkey", F.col("p_brand").alias("project"), F.concat("p_brand", F.lit("/thumbnail."), name).alias("path"))
    # The join moves what an image is made of; its bytes, a megabyte and more, are made behind it and are in no shuffle or sort.
    files = _with_content(named.join(t["part"].select("p_partkey", "p_size", "p_name"), "p_partkey"))
    return im.pick_images(files.select("project", "path", "content"))
