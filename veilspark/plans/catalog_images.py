"""Queries of image requests, files, text recognition and mosaics, over images whose pixels follow from keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.validators import image_error
from ..operators.images import BOX, image_entities, parse_ocr, redact_requests, requested_image_entities, with_ocr
from ..operators.mosaic import STYLES
from ..sources.images import check_files, encode, read_images, save_image_files
from ..sources.texts import parse_form
from .catalog import _docs, _made, _only, _recognizer, white_shots
from .pipeline import entity_rows

FILES = """SELECT c_custkey, 'up/a.b/f' || CAST(c_custkey AS STRING) || CASE c_custkey % 8 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.bmp' WHEN 4 THEN '.Gif' WHEN 5 THEN '.webp' WHEN 6 THEN '.tiff' ELSE '' END AS path,
 c_custkey * 7919 % 20971520 * 13 % 20971520 AS size FROM customer"""
FORMS = """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '["CN_EMAIL","CN_NAME"]' WHEN 1 THEN '[]' END AS entities, CASE WHEN c_custkey % 2 = 0 THEN '["a' || CAST(c_custkey AS STRING) || '"]' ELSE '["x","y z"]' END AS allow_list,
 CASE WHEN c_custkey % 5 = 0 THEN 'red,1,2' ELSE CAST(c_custkey % 256 AS STRING) || ', ' || CAST(c_custkey * 3 % 256 AS STRING) || ',' || CAST(c_custkey * 7 % 256 AS STRING) END AS fill_color FROM customer"""
#: Height and width of made images, and the area that mosaics cover.
HEIGHT, WIDTH, AREA = 40, 60, (10, 5, 45, 30)


def image_file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, FILES, "customer").select("c_custkey", image_error(F.col("path"), F.col("size")).alias("error"))


def image_form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_form(_made(spark, sf_dir, FORMS, "customer"))
    return rows.select("c_custkey", F.array_join("entities", " ").alias("entities"), F.array_join("allow_list", " ").alias("allow_list"), *[F.coalesce(F.get("fill_color", F.lit(i)), F.lit(-1)).alias(n) for i, n in enumerate(("red", "green", "blue"))])


def image_entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis only: nothing is painted."""
    found = image_entities(with_ocr(white_shots(spark, sf_dir), _recognizer), _only(C.EMAIL))
    return entity_rows(found, ["c_custkey"], "pii_entities").withColumnsRenamed({"left": "left_x", "top": "top_y"})


def image_request_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose rows ask for types, allowed lines and a colour of their own: entities, and pixels of that colour."""
    import zlib

    import numpy as np

    @F.pandas_udf("long")
    def coloured(png, red):
        out = []
        for x, r in zip(png, red, strict=True):
            if x is None:
                out.append(None)
                continue
            rows = np.frombuffer(zlib.decompress(x[41 : x.rindex(b"IEND") - 8]), np.uint8).reshape(40, 1 + 220 * 3)[:, 1:].reshape(40, 220, 3)
            out.append(int((rows[1:] == (r, 10, 20)).all(axis=2).sum()))
        return __import__("pandas").Series(out, dtype="Int64")

    key = F.col("c_custkey")
    rows = white_shots(spark, sf_dir).select(
        "*", F.when(key % 11 == 0, F.array(F.lit(C.PHONE))).when(key % 2 == 0, F.array(F.lit(C.EMAIL))).alias("entities"), F.when(key % 7 < 3, F.array(F.lit("x@y.org"))).alias("allow_list"),
        F.when(key % 13 == 0, 0.9).alias("score_threshold"), F.when(key % 17 == 0, "none").otherwise("fill").alias("mosaic_style"), F.array((key % 200).cast("int"), F.lit(10), F.lit(20)).alias("fill_color"),
    )
    done = redact_requests(requested_image_entities(with_ocr(rows, _recognizer), _only(C.EMAIL)))
    return done.select("c_custkey", F.size("pii_entities").cast("long").alias("n_entities"), F.array_join(F.transform("pii_entities", lambda e: e["text"]), " ").alias("lines"), F.coalesce(coloured("png", (key % 200).cast("int")), F.lit(-1)).cast("long").alias("covered"))


def ocr_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of text recognition in each shape that engines return; blank lines and missing places included."""
    from types import SimpleNamespace

    kind = f"struct<text:string,boxes:array<{BOX}>,confidence:double>"

    @F.pandas_udf(kind)
    def parse(key):
        rows = []
        for k in map(int, key):
            box, poly = [k, 5, k + 50, 25], [[k, 5], [k + 50, 6], [k + 50, 25], [k, 24]]
            shapes = (
                [{"rec_texts": [f"a{k}", " "], "rec_scores": [0.5, 0.9], "rec_boxes": [box, box]}], [{"rec_texts": [f"a{k}", "b"], "rec_scores": [0.5, 1.0], "rec_polys": [poly, poly]}],
                [SimpleNamespace(rec_texts=[f"a{k}"], rec_scores=[0.75], rec_boxes=None, rec_polys=None, dt_polys=[poly])], [[[poly, (f"a{k}", 0.25)], [poly, ("b", 0.75)]]], None,
            )
            rows.append(parse_ocr(shapes[k % 5]))
        return __import__("pandas").DataFrame(rows, columns=["text", "boxes", "confidence"])

    found = _docs(spark, sf_dir, "customer").select("c_custkey", parse("c_custkey").alias("r"))
    places = F.array_join(F.transform("r.boxes", lambda b: F.concat_ws(",", b["left"], b["top"], b["width"], b["height"])), " ")
    return found.select("c_custkey", "r.text", places.alias("places"), "r.confidence")


def image_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-coloured images are written as PNG and BMP files, checked, and read again by the image source."""

    @F.pandas_udf("binary")
    def paint(key, image_format):
        import numpy as np

        one = lambda k: np.full((6, 7 + k % 4, 3), (k * 9 % 256, k * 5 % 256, 255 - k), np.uint8)
        return __import__("pandas").Series([encode(one(int(k)), f) for k, f in zip(key, image_format, strict=True)])

    folder = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/images-{uuid.uuid4().hex}"
    style = F.when(F.col("n_nationkey") % 2 == 0, "PNG").otherwise("BMP")
    made = _docs(spark, sf_dir, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit("."), F.lower(style)).alias("name"), paint("n_nationkey", style).alias("png"))
    save_image_files(made, folder, "name")
    key = lambda path: F.regexp_extract(path, r"(\d+)\.[a-z]+$", 1).cast("int").alias("n_nationkey")
    seen = check_files(spark, folder).select(key("path"), "error")
    return read_images(spark, folder).select(key("origin"), "height", "width", F.md5("data").alias("digest")).join(seen, "n_nationkey")


def mosaic_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of made images under fill and coarse pixels."""

    @F.pandas_udf("string")
    def paint(key, style):
        import hashlib

        import numpy as np

        y, x, c = np.ogrid[:HEIGHT, :WIDTH, :3]
        one = lambda k: ((y * 7 + x * 13 + c * 29 + k * 31) % 256).astype(np.uint8)
        return __import__("pandas").Series([hashlib.md5(STYLES[s](one(int(k)), AREA, **({"fill_color": (1, 2, 3)} if s == "fill" else {})).tobytes()).hexdigest() for k, s in zip(key, style, strict=True)])

    rows = _docs(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(F.lit("fill"), F.lit("pixel"))).alias("name"))
    return rows.select("n_nationkey", "name", paint("n_nationkey", "name").alias("digest"))


FUNCTIONS = (image_file_checks, image_form_fields, image_entity_rows, image_request_redact, ocr_shapes, image_round_trip, mosaic_pixels)
