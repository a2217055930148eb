import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark import constants as C
from veilspark.config import PiiConfig
from veilspark.functions.masks import Rewrite, fake, mask, mask_email, requested_rewrites
from veilspark.operators import images, mosaic
from veilspark.operators.geometry import merge_adjacent, unite
from veilspark.operators.udtf import register
from veilspark.plans.pipeline import OPERATORS, anonymize, anonymize_distinct, anonymize_requests, report, with_json
from veilspark.sources.images import check_files, read_images, to_png
from veilspark.sources.texts import envelope, parse_form, split_requests, write_json
from veilspark.streaming.pipeline import anonymize_stream, read_texts


def anonymized(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r.anonymized_text for r in anonymize(df, **options).orderBy("id").collect()]


@pytest.mark.parametrize(("text", "char", "prefix", "suffix", "expected"), [
    ("13812345678", "*", 3, 4, "138****5678"), ("13812345678", "*", 0, 4, "*******5678"), ("13812345678", "*", 3, 0, "138********"), ("13812345678", "*", 0, 0, "***********"), ("13812345678", "#", 3, 4, "138####5678"),
    ("ab", "*", 1, 1, "ab"), ("", "*", 3, 4, ""), ("1101 0119 9001 0112 37", "*", 6, 4, "1101 0************2 37"),
])
def test_mask(spark, text, char, prefix, suffix, expected):
    assert spark.createDataFrame([(text,)], "t string").select(mask(F.col("t"), prefix, suffix, char)).first()[0] == expected


def test_texts(spark):
    mixed = "张三的手机号是13812345678，身份证号是110101199001011237，邮箱是test@example.com"
    assert anonymized(spark, [mixed, "没有", "", None, "护照号E12345678"]) == ["张三的手机号是138****5678，身份证号是110101********1237，邮箱是te**@*******.com", "没有", "", None, "护照号E1*****78"]
    assert anonymized(spark, ["号13812345678"], rewrites=requested_rewrites({C.PHONE: {"type": "mask", "masking_char": "#", "keep_prefix": 3, "keep_suffix": 2}, C.EMAIL: {"type": "other"}})) == ["号138######78"]
    assert anonymized(spark, ["王五"], config=PiiConfig(name_deny_list=("王五",))) == ["<CN_NAME>"]
    assert anonymized(spark, ["a@b.org x"], rewrites={C.EMAIL: Rewrite("custom", function=F.upper)}) == ["A@B.ORG x"]
    long = "这是填充。" * 100 + "13812345678" + "这是填充。" * 100
    assert anonymized(spark, [long])[0].count("138****5678") == 1
    with pytest.raises(ValueError):
        Rewrite("nothing")


def test_requests_by_row(spark):
    text = "电话13812345678，邮箱test@example.com"
    rows = [
        (0, text, None, None, None), (1, text, [C.EMAIL], None, None), (2, text, [C.PHONE], 0.99, None), (3, None, [C.PHONE], None, None), (4, text, [], None, None),
        (5, text, None, None, {C.PHONE: ("mask", 1, 2, "#", None), C.EMAIL: ("other", 0, 0, None, None)}), (6, "", None, 0.0, None),
    ]
    kind = f"id int, text string, entities array<string>, score_threshold double, operators {OPERATORS}"
    found = {r.id: r.anonymized_text for r in anonymize_requests(spark.createDataFrame(rows, kind)).collect()}
    whole = "电话138****5678，邮箱te**@*******.com"
    assert found == {0: whole, 1: "电话13812345678，邮箱te**@*******.com", 2: text, 3: None, 4: text, 5: "电话1########78，邮箱te**@*******.com", 6: ""}
    assert [r.anonymized_text for r in anonymize_requests(spark.createDataFrame([(text,)], "text string")).collect()] == [whole]


def test_distinct_texts_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "a@b.org"), (2, None), (3, "a@b.org"), (4, "")], "id int, text string")
    found = {r.id: (r.text, r.anonymized_text, len(r.pii_entities)) for r in anonymize_distinct(df).collect()}
    assert found == {1: ("a@b.org", "*@*.org", 1), 2: (None, None, 0), 3: ("a@b.org", "*@*.org", 1), 4: ("", "", 0)} and anonymize_distinct(df).columns == ["id", "text", "anonymized_text", "pii_entities"]


def test_other_operators(spark):
    df = spark.createDataFrame([("abc@d.cn",)], "v string")
    value = F.col("v")
    row = df.select(mask_email(value), Rewrite("hash").apply(C.EMAIL, value), Rewrite("encrypt", key="k" * 16).apply(C.EMAIL, value), Rewrite("mask", chars_to_mask=3).apply(C.EMAIL, value), fake(C.EMAIL, value) == fake(C.EMAIL, value), fake("OTHER", value)).first()
    assert row[0] == "ab*@*.cn" and len(row[1]) == 64 and row[2] != "abc@d.cn" and row[3] == "***@d.cn" and row[4] and row[5] == "abc@d.cn"


def test_results(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@b.org", "en"), (2, "a@b.org", "en"), (3, "-", "en")], "id int, text string, lang string")
    done = anonymize(df)
    assert {(r.entity_type, r.n_entities, r.n_texts) for r in report(done, ["lang"]).collect()} == {(C.EMAIL, 2, 2)}
    assert anonymize_distinct(df).count() == 3
    write_json(with_json(done), str(tmp_path / "json"))
    assert '"has_pii":true' in spark.read.text(str(tmp_path / "json")).where("value like '%b.org%'").first()[0]
    good, bad = split_requests(df.withColumn("score_threshold", F.lit(2.0)))
    assert good.count() == 0 and bad.first().error.startswith("score_threshold")
    assert {r.code for r in envelope(bad, "text", "error").collect()} == {400}
    form = parse_form(spark.createDataFrame([('["CN_EMAIL"]', "[]", "1, 2,3")], "entities string, allow_list string, fill_color string")).first()
    assert form.entities == ["CN_EMAIL"] and form.fill_color == [1, 2, 3]
    register(spark)
    assert spark.sql("SELECT entity_type FROM pii_candidates('x a@b.org')").first()[0] == C.EMAIL


def test_no_shuffle(spark):
    plan = anonymize(spark.createDataFrame([("x",)], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.org"), (2, "x")], "id int, text string").write.parquet(str(tmp_path / "in"))
    query = anonymize_stream(read_texts(spark, str(tmp_path / "in"), "id int, text string"), str(tmp_path / "out"), str(tmp_path / "marks"))
    query.awaitTermination(60)
    assert {r.anonymized_text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"*@*.org", "x"}


def test_geometry():
    assert merge_adjacent([("139", 0, 0, 30, 20), ("12345678", 40, 2, 80, 20)]) == [("13912345678", 0, 0, 120, 20)]
    assert merge_adjacent([("a", 0, 0, 10, 5), ("b", 60, 0, 10, 5), ("c", 0, 40, 5, 5)]) == [("a", 0, 0, 10, 5), ("b", 60, 0, 10, 5), ("c", 0, 40, 5, 5)]
    assert unite([(0, 0, 10, 10), (18, 0, 10, 10), (100, 100, 5, 5)]) == [(-5, -5, 33, 15), (95, 95, 110, 110)]


def test_mosaic():
    white = np.full((100, 100, 3), 255, np.uint8)
    assert mosaic.fill(white, (10, 10, 50, 50))[30, 30].tolist() == [0, 0, 0] and mosaic.fill(white, (10, 10, 50, 50))[50, 50].tolist() == [0, 0, 0]
    assert (mosaic.pixel(white, (50, 50, 10, 10)) == white).all()
    noise = np.random.default_rng(1).integers(0, 256, (40, 40, 3), dtype=np.uint8)
    coarse = mosaic.pixel(noise, (0, 0, 40, 40), 10)
    assert len(np.unique(coarse[:, :, 0])) <= 16 and (coarse[:10, :10] == coarse[0, 0]).all()
    assert mosaic.blur(noise, (5, 5, 30, 30))[5:30, 5:30].std() < noise[5:30, 5:30].std() and (mosaic.blur(noise, (5, 5, 30, 30))[30:] == noise[30:]).all()
    with pytest.raises(ValueError):
        mosaic.cover(white, [(0, 0, 1, 1)], "none")


def test_ocr_shapes():
    flat = images.parse_ocr({"rec_texts": ["测试", " "], "rec_scores": [0.95, 0.5], "rec_boxes": [[0, 0, 10, 5], [0, 0, 1, 1]]})
    assert flat["text"] == "测试" and flat["boxes"][0]["width"] == 10 and flat["confidence"] == 0.95
    pairs = images.parse_ocr([[[[0, 0], [10, 0], [10, 5], [0, 5]], ("测试", 0.95)], [[[0, 9], [10, 9], [10, 15], [0, 15]], ("文本", 0.85)]])
    assert pairs["text"] == "测试\n文本" and len(pairs["boxes"]) == 2 and abs(pairs["confidence"] - 0.9) < 1e-9
    rec = images.parse_ocr([{"box": [[1, 2], [3, 2], [3, 4], [1, 4]], "rec": {"text": "x", "conf": 0.5}}])
    assert rec["boxes"] == [{"text": "x", "left": 1, "top": 2, "width": 2, "height": 2}]
    assert images.parse_ocr(None)["boxes"] == []


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(to_png(np.full((40, 200, 3), 255, np.uint8)))
    (tmp_path / "b.txt").write_text("x")
    assert {r.path[-5:]: r.error for r in check_files(spark, str(tmp_path)).collect()} == {"a.png": None, "b.txt": "unsupported image format: txt"}

    def engine():
        return lambda image: {"rec_texts": ["测试", "13812345678", "完成"], "rec_scores": [1, 1, 1], "rec_boxes": [[10, 10, 50, 30], [60, 10, 200, 30], [210, 10, 300, 30]]}

    shots = images.with_ocr(read_images(spark, str(tmp_path / "a.png")), engine)
    found = images.image_entities(shots)
    row = images.redact(found, "fill").first()
    assert [(e.entity_type, e.text, e.left, e.width) for e in row.pii_entities] == [(C.PHONE, "测试13812345678完成", 10, 290)] and row.png[:4] == b"\x89PNG"
    assert images.image_entities(shots, config=PiiConfig(allow_list=("测试13812345678完成",))).first().pii_entities == []
    with pytest.raises(ValueError):
        images.redact(found, "no")
