import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark import constants as C
from veilspark.config import PiiConfig
from veilspark.operators import images
from veilspark.operators.extraction import with_tokens
from veilspark.sources.images import encode, read_images, save_image_files, to_array

SHOT = "id int, height int, width int, n_channels int, data binary"


def engine():
    return lambda image: {"rec_texts": ["a@b.org", "13812345678"], "rec_scores": [1.0, 1.0], "rec_boxes": [[2, 2, 20, 8], [2, 24, 20, 30]]}


def test_image_requests_by_row(spark, tmp_path):
    white = bytearray(b"\xff" * (40 * 40 * 3))
    kind = SHOT + ", entities array<string>, allow_list array<string>, score_threshold double, mosaic_style string, fill_color array<int>"
    rows = [
        (0, None, None, None, "fill", [1, 2, 3]), (1, [C.EMAIL], None, None, "fill", None), (2, [], None, None, None, None), (3, None, ["a@b.org"], None, "pixel", None),
        (4, None, None, 0.99, "blur", None), (5, None, None, None, "other", None), (6, None, None, None, "fill", [1, None, 3]), (7, None, None, None, "fill", [1, 2, 300]),
    ]
    df = spark.createDataFrame([(r[0], 40, 40, 3, white, *r[1:]) for r in rows], kind)
    done = images.redact_requests(images.requested_image_entities(images.with_ocr(df, engine)), image_format="bmp").cache()
    found = {r.id: sorted(e.entity_type for e in r.pii_entities) for r in done.collect()}
    both = sorted([C.EMAIL, C.PHONE])
    assert found == {0: both, 1: [C.EMAIL], 2: [], 3: [C.PHONE], 4: [], 5: both, 6: both, 7: both}
    assert {r.id for r in done.where("png is null").collect()} == {5, 6, 7}  # bad requests cost no job

    folder = f"file://{tmp_path}/shots"
    save_image_files(done.withColumn("name", F.concat("id", F.lit(".bmp"))), folder, "name")
    pixels = {r.origin.rsplit("/", 1)[1]: to_array(r.data, r.height, r.width, r.n_channels) for r in read_images(spark, folder).collect()}
    assert sorted(pixels) == ["0.bmp", "1.bmp", "2.bmp", "3.bmp", "4.bmp"]
    assert (pixels["0.bmp"] == (1, 2, 3)).all(axis=2).sum() == 26 * 14 + 26 * 17 and tuple(pixels["0.bmp"][5, 5]) == (1, 2, 3)
    assert (pixels["1.bmp"] == 0).all(axis=2).sum() == 26 * 14 and (pixels["2.bmp"] == 255).all()


def test_requests_without_wishes(spark):
    df = spark.createDataFrame([(0, 40, 40, 3, bytearray(b"\xff" * (40 * 40 * 3)))], SHOT)
    row = images.redact_requests(images.requested_image_entities(images.with_ocr(df, engine), PiiConfig(entities=(C.EMAIL,)))).first()
    assert [e.entity_type for e in row.pii_entities] == [C.EMAIL] and row.png[:4] == b"\x89PNG"


def test_formats():
    with pytest.raises(ValueError):
        encode(np.zeros((2, 2, 3), np.uint8), "webp")
    assert encode(np.zeros((2, 3, 3), np.uint8), "bmp")[:2] == b"BM"


def test_plugged_tokenizer(spark):
    def make():
        return lambda text: [text[0]] if text != "bad one" else 1 / 0

    df = spark.createDataFrame([(0, "ab c"), (1, "bad one"), (2, None), (3, "")], "id int, text string")
    assert {r.id: r.tokens for r in with_tokens(df, make).collect()} == {0: ["a"], 1: ["bad", "one"], 2: [], 3: []}
    assert {r.id: r.tokens for r in with_tokens(df).collect()}[0] == ["ab", "c"]
