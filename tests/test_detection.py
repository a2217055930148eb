import datetime
import random

import pytest
from pyspark.sql import functions as F

from tests import model
from veilspark import constants as C
from veilspark.config import PiiConfig, supported_entities
from veilspark.functions import validators as V
from veilspark.functions.spans import SPANS
from veilspark.operators.extraction import ListModel, with_extractions
from veilspark.operators.resolve import best_by_position, by_priority, drop_contained, merge_phones
from veilspark.plans.pipeline import analyze, thresholded

AS_OF = datetime.date(2025, 1, 1)


def spans_of(spark, texts, **config):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = analyze(df, config=PiiConfig(as_of=AS_OF, **config)).orderBy("id").collect()
    return [[(s.entity_type, s.start, s.end, round(s.score, 6)) for s in r.pii_spans] for r in rows]


CASES = [
    (C.PHONE, "手机号是+86 138-1234-5678", 1), (C.PHONE, "数字12345678901不是手机号", 0), (C.PHONE, "两个手机号13812345678和13987654321", 2), (C.PHONE, "联系电话：+8613812345678", 1), (C.PHONE, "138-1234-13912345678", 1),
    (C.PHONE, "1381234567８ 和 138　1234　5678", 2), (C.ID_CARD, "证件号码：110101199003077475", 1), (C.ID_CARD, "身份证 1101  0119  9001  0112  37", 1), (C.ID_CARD, "11010519950824352X", 0), (C.ID_CARD, "4127283197611144009", 1),
    (C.BANK_CARD, "4111 1111 1111 1111", 1), (C.BANK_CARD, "编号A4111111111111111", 0), (C.BANK_CARD, "统一社会信用代码91310000552936878J", 0), (C.BANK_CARD, "1 4111111111111111", 0), (C.BANK_CARD, "银行卡号6222021234567890123", 0),
    (C.PASSPORT, "护照号E12345678", 1), (C.PASSPORT, "通行证C12345678", 1), (C.PASSPORT, "xE12345678", 0), (C.EMAIL, "两个邮箱test@qq.com和test@163.com", 2), (C.EMAIL, "test@example..com", 0), (C.PHONE, "", 0), (C.PHONE, None, 0),
]


def test_counts(spark):
    for entity in C.PRIORITIES:
        mine = [(t, n) for e, t, n in CASES if e == entity]
        if mine:
            found = spans_of(spark, [t for t, _ in mine], entities=(entity,))
            assert [len(f) for f in found] == [n for _, n in mine], entity


def test_spans_and_scores(spark):
    found = spans_of(spark, ["联系电话：+8613812345678", "电话：138-1234-5678", "身份证号110101199001011237", "护照号E12345678", "13812345678@qq.com", "AB123456@qq.com", "中😀 4111111111111111"])
    assert found[0] == [(C.PHONE, 5, 19, 0.9)] and found[1] == [(C.PHONE, 3, 16, 0.75)] and found[2] == [(C.ID_CARD, 4, 22, 0.95)] and found[3] == [(C.PASSPORT, 3, 12, 0.65)]
    assert [s[0] for s in found[4]] == [C.PHONE] and [s[0] for s in found[5]] == [C.PASSPORT]
    assert found[6] == [(C.BANK_CARD, 3, 19, 0.7)]


def test_against_the_model(spark):
    rng = random.Random(3)
    parts = ["13812345678", "+86", "0086", "138-1234-5678", "110101199001011237", "4127283197611144009", "4111111111111111", "4111 1111 1111 1111", "6222021234567890", "E12345678", "EA12345678", "h12345678", "a.b@qq.com", "x@y..com",
             " ", "-", "a", "Z", "9", "号", "，", "\n", "\t", "@", ".", "12345"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 8))) for _ in range(600)]
    expected = [[(e, a, b, round(s, 6)) for e, a, b, s in model.analyze(t, AS_OF)] for t in texts]
    found = spans_of(spark, texts)
    wrong = [(t, f, x) for t, f, x in zip(texts, found, expected, strict=True) if f != x]
    assert not wrong, wrong[:3]


def test_folds_against_the_model(spark):
    rng = random.Random(5)
    kinds = list(C.PRIORITIES)
    cases = [[(rng.choice(kinds), a := rng.randint(0, 30), a + rng.randint(1, 12), rng.choice([0.0, 0.5, 0.7, 0.9])) for _ in range(rng.randint(0, 7))] for _ in range(400)]
    df = spark.createDataFrame([(i, [(*s, "") for s in c]) for i, c in enumerate(cases)], f"id int, spans {SPANS}")
    rows = df.select("id", by_priority(F.col("spans")).alias("p"), drop_contained(F.col("spans")).alias("d"), merge_phones(F.col("spans")).alias("m")).orderBy("id").collect()
    plain = lambda spans: [(s.entity_type, s.start, s.end, s.score) for s in spans]
    for r, c in zip(rows, cases, strict=True):
        assert sorted(plain(r.p)) == sorted(model.priority(c))
        assert plain(r.d) == model.contained(c)
        assert all(not model.clash(a, b) for k, a in enumerate(plain(r.m)) for b in plain(r.m)[k + 1 :])


@pytest.mark.parametrize(("spans", "expected"), [
    ([(C.PHONE, 0, 11), (C.ID_CARD, 0, 18)], [C.ID_CARD]), ([(C.PHONE, 5, 16), (C.BANK_CARD, 0, 16), (C.ID_CARD, 0, 18)], [C.ID_CARD]), ([(C.PHONE, 0, 11), (C.ID_CARD, 11, 29)], [C.PHONE, C.ID_CARD]),
    ([(C.ID_CARD, 0, 10), (C.BANK_CARD, 5, 20), (C.PHONE, 15, 30)], [C.ID_CARD, C.PHONE]), ([], []),
])
def test_priority_cases(spark, spans, expected):
    df = spark.createDataFrame([([(*s, 1.0, "") for s in spans],)], f"spans {SPANS}")
    assert [s.entity_type for s in df.select(by_priority(F.col("spans")).alias("k")).first().k] == expected


def test_validators(spark):
    def check(function, good, bad):
        df = spark.createDataFrame([(v,) for v in [*good, *bad]], "v string")
        assert [r[0] for r in df.select(function(F.col("v"))).collect()] == [True] * len(good) + [False] * len(bad)

    check(V.is_phone, ["13812345678", "+8613812345678", "008613812345678", "138-1234-5678"], ["12812345678", "1381234567", "138123456789", "abcdefghijk"])
    check(lambda v: V.is_id_card(v, AS_OF), ["110101199001011237", "110101199003077475", "310101198001010018"], ["110101199001011234", "110101199013011234", "000101199001011234", "123456789012345678"])
    check(lambda v: V.is_birth_date(v, AS_OF), ["19900101", "20001231"], ["18991231", "20251301", "19900132", "19900230"])
    check(V.is_bank_card, ["4111111111111111", "5500000000000004", "3566002020360505"], ["4111111111111112", "1234567890123456"])
    check(V.is_passport, ["E12345678", "C12345678", "AB123456"], ["12345678", "", "ABC"])
    check(V.is_email, ["test@example.com", "test_email@qq.com"], ["", "test", "@example.com", "test@", "test@.com", "test@example..com"])


def test_lists_thresholds_and_context(spark):
    both = spans_of(spark, ["王五和赵六一起工作，王五"], entities=(C.NAME,), name_deny_list=("王五", "赵六"))
    assert both[0] == [(C.NAME, 0, 2, 1.0), (C.NAME, 3, 5, 1.0), (C.NAME, 10, 12, 1.0)]
    assert spans_of(spark, ["a@b.org 和 c@d.org"], allow_list=("a@b.org",))[0] == [(C.EMAIL, 10, 17, 0.85)]
    assert spans_of(spark, ["护照号E12345678"], score_threshold=0.7) == [[]]
    assert spans_of(spark, ["护照号 E12345678"], score_threshold=0.7, context_boost=True) == [[(C.PASSPORT, 4, 13, 1.0)]]
    with pytest.raises(ValueError):
        PiiConfig(entities=("NO_SUCH",))
    with pytest.raises(ValueError):
        supported_entities("fr")
    config = PiiConfig.from_env({"Score_Threshold_Phone": "0.8", "NAME_DENY_LIST": " 张三 ,,李四"})
    assert config.threshold_of(C.PHONE) == 0.8 and config.name_deny_list == ("张三", "李四") and config.update_name_lists(allow=[" x "]).name_allow_list == ("x",)
    df = spark.createDataFrame([([(C.NAME, 0, 1, 0.32, ""), (C.NAME, 2, 3, 0.36, "")],)], f"spans {SPANS}")
    assert len(df.select(thresholded(F.col("spans"), PiiConfig()).alias("k")).first().k) == 1  # the floor holds


def test_extraction(spark):
    df = spark.createDataFrame([(0, "张三和张三住在北京市朝阳区建国路88号"), (1, "家庭住址：北京市朝阳区建国路88号"), (2, "上海市"), (3, None)], "id int, text string")
    found = with_extractions(df, lambda: ListModel({"姓名": ["张三"], "地址": ["北京市朝阳区建国路88号", "上海市"]}))
    rows = analyze(found, config=PiiConfig(entities=(C.NAME, C.ADDRESS), ie_column="ie")).orderBy("id").collect()
    assert [[(s.entity_type, s.start, s.end) for s in r.pii_spans] for r in rows] == [[(C.NAME, 0, 2), (C.ADDRESS, 7, 19)], [], [], []]
    every = analyze(found, config=PiiConfig(entities=(C.NAME,), ie_column="ie", all_occurrences=True)).orderBy("id").first()
    assert [(s.start, s.end) for s in every.pii_spans] == [(0, 2), (3, 5)]
    best = spark.createDataFrame([([(C.NAME, 0, 2, 0.5, ""), (C.NAME, 0, 2, 0.9, "")],)], f"s {SPANS}").select(best_by_position(F.col("s")).alias("k")).first().k
    assert [s.score for s in best] == [0.9]

    def broken():
        def fail(texts):
            raise RuntimeError

        return fail

    assert with_extractions(df, broken).where("size(ie) > 0").count() == 0
