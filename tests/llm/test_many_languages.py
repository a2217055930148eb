"""Every language of the training rows is told apart, however many there are."""

import random

import pytest

from veilspark.llm import langid


def test_more_than_64_languages(spark, monkeypatch):
    rng = random.Random(30)
    letters = "abcdefghijklmnopqrstuvwxyz"
    parts = {f"l{k:03}": ["".join(rng.choice(letters) for _ in range(3)) for _ in range(8)] for k in range(140)}
    text = lambda x: " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 3))) for _ in range(40))
    rows = [(k, x, text(x)) for k, x in enumerate(sorted(parts))]
    rows += [(1000 + k, x, text(x)) for k, x in enumerate(sorted(parts)) for _ in range(3 if k < 64 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.train(docs.where("doc_id >= 1000"))
    assert model.languages == sorted(parts)
    found = langid.predict(docs, model, ["doc_id", "lang"]).where("doc_id < 1000").collect()
    assert len(found) == 140 and all(r.lang_pred == r.lang and [s.lang for s in r.spans] == [r.lang] for r in found)
    monkeypatch.setattr(langid, "MOST", 139)
    with pytest.raises(ValueError, match="139 languages"):
        langid.train(docs)
