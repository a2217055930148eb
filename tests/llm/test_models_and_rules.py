import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import sentence
from veilspark.llm import hmm_lm, html_extract, kn_quality, langid, quality_rules


def held_out(n, r):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(n)) == r


def test_forward_recursion_is_exact(monkeypatch):
    """Against a sum over all paths, also where texts are cut into segments."""
    rng = np.random.default_rng(1)
    emit, move, start = rng.random((5, 3)), rng.random((3, 3)), rng.random(3)
    t = hmm_lm.Tables(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    texts = [[0], [1, 2], [4, 3, 2, 1, 0, 1, 2], [2] * 8, [0, 1, 2, 3, 4, 0]]
    symbols, off = np.array(sum(texts, [])), np.cumsum([0, *map(len, texts)])

    def total(seq):
        e = t.emit.astype(float)
        return sum(t.start[p[0]] * math.prod(e[s, q] for s, q in zip(seq, p, strict=True)) * math.prod(t.move[a, b] for a, b in zip(p, p[1:])) for p in itertools.product(range(3), repeat=len(seq)))

    for segment in (100, 3, 1):
        assert np.allclose(hmm_lm.log_likelihood(t, symbols, off, segment), [math.log(total(x)) for x in texts])
    starts, moves, post, order, value = hmm_lm.expected_counts(t, symbols, off)
    assert abs(value - sum(math.log(total(x)) for x in texts)) < 1e-3
    assert np.allclose(post.sum(axis=1), 1, atol=1e-4) and abs(starts.sum() - len(texts)) < 1e-3 and abs(moves.sum() - (len(symbols) - len(texts))) < 1e-2
    assert sorted(order) == sorted(symbols)


def test_expected_counts_are_those_of_all_paths():
    """Of whole texts, however many pieces they advance in."""
    rng = np.random.default_rng(3)
    emit, move, start = rng.random((5, 3)), rng.random((3, 3)), rng.random(3)
    t = hmm_lm.Tables(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    texts = [[0], [1, 2], [4, 3, 2, 1, 0, 1, 2], [2] * 8, [0, 1, 2, 3, 4, 0], [3, 3, 1]]
    symbols, off = np.array(sum(texts, [])), np.cumsum([0, *map(len, texts)])
    e, starts, moves, emits = t.emit.astype(float), np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for x in texts:
        paths = list(itertools.product(range(3), repeat=len(x)))
        weight = np.array([t.start[p[0]] * math.prod(e[s, q] for s, q in zip(x, p, strict=True)) * math.prod(t.move[a, b] for a, b in zip(p, p[1:])) for p in paths])
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            starts[p[0]] += w
            for s, q in zip(x, p, strict=True):
                emits[s, q] += w
            for a, b in zip(p, p[1:]):
                moves[a, b] += w
    for most in (100, 4, 3, 2, 1):
        a, m, post, order, _ = hmm_lm.expected_counts(t, symbols, off, most)
        found = np.stack([np.bincount(order, weights=post[:, q], minlength=5) for q in range(3)], axis=1)
        assert np.allclose(a, starts, atol=1e-4) and np.allclose(m, moves, atol=1e-4) and np.allclose(found, emits, atol=1e-4), most


def test_training_in_spark_is_em(spark):
    """One round of :func:`baum_welch` against the counts of all texts in one piece; scores against the recursion, and
    probabilities of all words after any beginning sum to one."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 9, rng.integers(1, 40)) for _ in range(30)]
    rows = spark.createDataFrame([(x.astype("<u2").tobytes(),) for x in texts], "seq binary").repartition(3)
    symbols, off = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    frequency = np.bincount(symbols, minlength=9).astype(float)
    first, second = (hmm_lm.baum_welch(rows, frequency, 3, n) for n in (1, 2))
    starts, moves, post, order, _ = hmm_lm.expected_counts(first, symbols, off)
    counts = np.stack([np.bincount(order, weights=post[:, q], minlength=9) for q in range(3)], axis=1)
    prior = (frequency + 0.01) / (frequency + 0.01).sum()
    counts += hmm_lm.PRIOR * prior[:, None]
    assert np.allclose(second.emit, counts / counts.sum(axis=0), atol=1e-4)
    assert np.allclose(second.move, (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True), atol=1e-3)
    assert np.allclose(second.start, (starts + 0.1) / (starts + 0.1).sum(), atol=1e-3)
    one = [np.append(texts[0][:5], k) for k in range(9)]
    p = hmm_lm.log_likelihood(second, np.concatenate(one), np.cumsum([0, *map(len, one)]))
    whole = hmm_lm.log_likelihood(second, texts[0][:5], np.array([0, len(texts[0][:5])]))
    assert abs(np.exp(p - whole[0]).sum() - 1) < 1e-6


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(2)
    texts = [rng.choice(6, 30, p=[0.4, 0.4, 0.2, 0, 0, 0]) if k % 2 else rng.choice(6, 30, p=[0, 0, 0, 0.2, 0.4, 0.4]) for k in range(40)]
    symbols, off = np.concatenate(texts), np.arange(0, 1201, 30)
    emit = np.random.default_rng(0).random((6, 2)) + 0.5
    t, values = hmm_lm.Tables(np.full(2, 0.5), np.array([[0.9, 0.1], [0.1, 0.9]]), emit / emit.sum(axis=0)), []
    for _ in range(12):
        starts, moves, post, order, value = hmm_lm.expected_counts(t, symbols, off)
        counts = np.stack([np.bincount(order, weights=post[:, s], minlength=6) for s in range(2)], axis=1) + 1e-9
        t = hmm_lm.Tables(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), counts / counts.sum(axis=0))
        values.append(value)
    assert all(b > a - 1e-2 for a, b in zip(values, values[1:])) and values[-1] > values[0] + 50


def test_hmm_scores(spark, odd_docs, odd_rows, no_docs):
    found = sorted(map(tuple, hmm_lm.score(odd_docs, held_out(10, 0), rounds=2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
    data = [(i, [*brute.words(t, True), None]) for i, t in odd_rows]
    out = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0
    count = Counter(w for i, ws in data if not out(i) for w in ws)
    size, distinct = sum(count.values()), len(count)
    expected = sorted(((i, out(i), len(ws), sum(count[w] > 0 for w in ws), size, sum(math.log10((count[w] + 0.1) / (size + 0.1 * (distinct + 1))) for w in ws)) for i, ws in data), key=str)
    assert len(found) == len(expected)
    for f, e in zip(sorted(found, key=lambda r: str(r[:5])), sorted(expected, key=lambda r: str(r[:5])), strict=True):
        assert f[:5] == e[:5] and math.isfinite(f[6])
    assert np.allclose(sorted(f[5] for f in found), sorted(e[5] for e in expected))
    assert hmm_lm.score(no_docs, held_out(10, 0), rounds=1).count() == 0
    only = hmm_lm.score(odd_docs.where(held_out(10, 0)), held_out(10, 0), rounds=1).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.score == 0 for r in only)


def test_kneser_ney_sums_to_one():
    rng = random.Random(3)
    texts = pa.array([sentence(rng, rng.randint(1, 15)) for _ in range(60)])
    s, row = kn_quality._stream(texts)
    ok = row[2:] == row[:-2]
    tri = Counter(zip(s[:-2][ok], s[1:-1][ok], s[2:][ok], strict=True))
    a, b, c = (np.array(x, np.uint64) for x in zip(*tri, strict=True))
    model = kn_quality.Model(a, b, c, np.array(list(tri.values())))
    vocabulary = np.concatenate([k for k, _ in model.one.shards])
    contexts = [(a[0], b[0]), (a[5], b[9]), (np.uint64(77), b[3]), (np.uint64(77), np.uint64(78)), (np.uint64(1), np.uint64(1))]
    for x, y in contexts:
        fill = lambda v: np.full(len(vocabulary) + 1, v, np.uint64)
        assert abs(model.probability(fill(x), fill(y), np.append(vocabulary, np.uint64(12345))).astype(float).sum() - 1) < 1e-4
    d = kn_quality.discounts(np.array([1] * 50 + [2] * 20 + [3] * 10 + [4] * 6))
    y = 50 / 90
    assert np.allclose(d, [0, 1 - 2 * y * 20 / 50, 2 - 3 * y * 10 / 20, 3 - 4 * y * 6 / 10])


def test_kneser_ney_tells_junk(spark, odd_docs, labels, no_docs, no_labels):
    rng = random.Random(8)
    rows = [(k, sentence(rng, 60), "en") for k in range(300)] + [(k, " ".join(f"zz{rng.random()}" for _ in range(60)), "en") for k in range(300, 330)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame([(k, 1 if k < 300 else 0) for k in range(330)], "doc_id long, quality int")
    found = kn_quality.classify(docs, known, quantile=0.98).collect()
    assert not any(r.kept for r in found if r.doc_id >= 300) and sum(r.kept for r in found if r.doc_id < 300) >= 290
    # about 100 documents outside the fit cannot hold the loss to 0.5 %: there is no cutoff
    assert all(r.kept and r.threshold is None for r in kn_quality.classify(docs, known).collect())
    # nulls are a language of their own, and not the empty one
    mixed = docs.selectExpr("doc_id", "text", "CASE WHEN doc_id % 2 = 0 THEN '' END AS lang")
    limits = {r.lang: r.threshold for r in kn_quality.classify(mixed, known, quantile=0.9).collect()}
    assert set(limits) == {"", None} and None not in limits.values() and limits[""] != limits[None]
    assert kn_quality.classify(odd_docs, labels).count() == odd_docs.count()
    assert kn_quality.classify(odd_docs, no_labels).where("kept").count() == odd_docs.count()
    assert kn_quality.classify(no_docs, labels).count() == 0


def test_kneser_ney_probabilities_are_those_of_the_formula():
    """Interpolated modified Kneser-Ney of three orders, written out with dictionaries."""
    rng = random.Random(12)
    texts = pa.array([sentence(rng, rng.randint(1, 12)) for _ in range(50)])
    s, row = kn_quality._stream(texts)
    ok = row[2:] == row[:-2]
    tri = Counter(zip(s[:-2][ok].tolist(), s[1:-1][ok].tolist(), s[2:][ok].tolist(), strict=True))
    bi = Counter((b, c) for _, b, c in tri)
    uni = Counter(c for _, c in bi)

    def cut(counts):
        d = kn_quality.discounts(np.array(list(counts.values())))
        return lambda n: d[min(n, 3)]

    def level(counts, discount, context, gram, lower):
        own = {g: n for g, n in counts.items() if g[:-1] == context}
        total = sum(own.values())
        return (max(0, own.get(gram, 0) - discount(own.get(gram, 0))) + sum(map(discount, own.values())) * lower) / total if total else lower

    d1, d2, d3 = cut(uni), cut(bi), cut(tri)
    base = sum(map(d1, uni.values())) / sum(uni.values()) / (len(uni) + 1)

    def p(a, b, c):
        one = (uni[c] - d1(uni[c])) / sum(uni.values()) + base if c in uni else base
        return level(tri, d3, (a, b), (a, b, c), level(bi, d2, (b,), (b, c), one))

    columns = [np.array(x, np.uint64) for x in zip(*tri, strict=True)]
    model = kn_quality.Model(*columns, np.array(list(tri.values())))
    vocabulary = [*uni, 99]
    asked = [(rng.choice(vocabulary), rng.choice(vocabulary), rng.choice(vocabulary)) for _ in range(60)] + rng.sample(list(tri), 40)
    found = model.probability(*[np.array(x, np.uint64) for x in zip(*asked, strict=True)])
    assert np.allclose(found, [p(*x) for x in asked], rtol=1e-4)


def test_kneser_ney_fits_all_trusted_texts(spark):
    """More trusted documents than any fixed number of them: every text has the score of a model of all."""
    rng = random.Random(21)
    rows = [(k, sentence(rng, rng.randint(0, 12)) + f" w{k % 700}", "en") for k in range(7000)] + [(7000, None, None), (7001, "x " * 3000, "en"), (7002, rows_of := "the an er", "en"), (7003, rows_of, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame([(k, 1) for k in range(6600)], "doc_id long, quality int")
    found = {r.doc_id: r for r in kn_quality.classify(docs, known).collect()}
    s, row = kn_quality._stream(pa.array([t for k, t, _ in rows[:6600] if zlib.crc32(str(k).encode()) % 3]))
    ok = row[2:] == row[:-2]
    tri = Counter(zip(s[:-2][ok].tolist(), s[1:-1][ok].tolist(), s[2:][ok].tolist(), strict=True))
    model = kn_quality.Model(*[np.array(x, np.uint64) for x in zip(*tri, strict=True)], np.array(list(tri.values())))
    assert len(found) == len(rows) and sum(r.threshold is not None for r in found.values()) == len(rows) - 1
    for k, t, _ in rows[::50] + rows[-4:]:
        s, _ = kn_quality._stream(pa.array([t or ""]))
        total = np.log10(model.probability(s[:-2], s[1:-1], s[2:]).astype(float)).sum()
        assert found[k].n_tokens == len(s) - 2 and np.isclose(found[k].log10_prob, total, rtol=1e-5)
        assert np.isclose(found[k].perplexity, 10 ** (-total / (len(s) - 2)), rtol=1e-4)


def viterbi_brute(scores, switch):
    return max(itertools.product(range(scores.shape[1]), repeat=len(scores)), key=lambda p: sum(scores[i, k] for i, k in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:])))


def test_viterbi():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes = rng.integers(0, 7, 4)
        scores = rng.normal(0, 3, (sizes.sum(), 3)).astype(np.float32)
        off = np.concatenate([[0], np.cumsum(sizes)])
        path = langid.viterbi(scores, off, 2.0)
        for a, b in zip(off, off[1:]):
            assert tuple(path[a:b]) == viterbi_brute(scores[a:b], 2.0)


def test_languages(spark, odd_docs, no_docs):
    rng = random.Random(5)
    other = lambda n: " ".join("".join(rng.choice("äöüßkzw") for _ in range(rng.randint(2, 6))) for _ in range(n))
    greek = lambda n: " ".join("".join(rng.choice("αβγδεζη") for _ in range(rng.randint(2, 6))) for _ in range(n))
    make = {"en": lambda n: sentence(rng, n), "de": other, "el": greek}
    rows = [(k, make[x](40), x) for k, x in enumerate(["en", "de", "el"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where("doc_id < 45"))
    assert model.languages == ["de", "el", "en"]
    found = langid.predict(docs, model, ["doc_id", "lang"]).where("doc_id >= 45").collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in found)
    mixed = spark.createDataFrame([(0, f"{sentence(rng, 20)} {greek(15)} {sentence(rng, 20)}"), (1, None), (2, "12 34 !"), (3, "Привет")], "doc_id long, text string")
    rows = langid.predict(mixed, model, ["doc_id"]).orderBy("doc_id").collect()
    assert [(s.first_word, s.end_word, s.lang) for s in rows[0].spans] == [(0, 20, "en"), (20, 35, "el"), (35, 55, "en")]
    assert [(r.lang_pred, r.score) for r in rows[1:3]] == [("und", 0.0)] * 2 and rows[3].lang_pred in model.languages
    assert langid.train(no_docs) is None and langid.predict(odd_docs, None, ["doc_id"]).where("lang_pred = 'und'").count() == odd_docs.count()
    assert langid.predict(odd_docs, langid.train(odd_docs), ["doc_id", "slot"]).count() == odd_docs.count() and langid.predict(no_docs, model, ["doc_id"]).count() == 0


def test_rule_counts(odd_docs, odd_rows, labels):
    found = quality_rules.judge(odd_docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()

    def expected(i, t):
        w, t = brute.words(t), t or ""
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        count, cover = Counter(windows), set()
        for k, x in enumerate(windows):
            if count[x] > 1:
                cover.update(range(k, k + 8))
        lines = [x for x in t.split("\n") if brute.words(x)]
        return i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)

    assert sorted(map(str, map(tuple, found))) == sorted(str(expected(i, t)) for i, t in odd_rows)


def test_bounds_are_exact():
    tail = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for k, n, delta in [(0, 50, 0.05), (3, 80, 0.01), (10, 40, 0.2), (1, 1000, 0.001)]:
        assert abs(tail(k, n, quality_rules.binomial_upper(k, n, delta)) - delta) < 1e-6
    assert quality_rules.binomial_upper(0, 0, 0.05) == 1 and quality_rules.binomial_upper(5, 5, 0.05) == 1
    assert quality_rules.certify([(0, 0), (1, 0), (2, 30), (3, 0)], 300, 0.05, 0.05) == 1 and quality_rules.certify([(0, 0)], 5, 0.05, 0.05) is None


def test_rules_reject_junk_and_keep_good(spark, odd_docs, labels, no_docs, no_labels):
    rng = random.Random(9)
    junk = lambda: " ".join(w + "###" for w in sentence(rng, 50).split())
    rows = [(k, sentence(rng, 50) if k < 700 else junk(), "en") for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame([(k, int(k < 700)) for k in range(800)], "doc_id long, quality int")
    found = quality_rules.judge(docs, known).collect()
    assert not any(r.kept for r in found if r.doc_id >= 700) and sum(r.kept for r in found if r.doc_id < 700) >= 665
    assert quality_rules.judge(odd_docs, no_labels).where("kept <> (not base_failed)").count() == 0
    assert quality_rules.judge(no_docs, labels).count() == 0


def test_pages(spark):
    blocks = lambda page: html_extract.page_blocks(page)
    assert blocks('<p>one<p>two <b>x</b>y<p class="ad">buy<p>three &lt;3 &amp;&nbsp;z<script>if(a<b)"<p>no</p>"</script><!-- c <p>no --><div id=comments>c<p>d</div><style>p{}</style>') == ["one", "two xy", "three <3 & z"]
    assert blocks("<nav>n</nav><header>h</header><main>m<article><h1>t</h1><p>a</p><aside>s</aside></article></main><footer>f</footer>") == ["m", "t", "a"]  # only what markup excludes is dropped
    assert blocks("") == [] and blocks("<p") == ["<p"] and blocks('<div hidden>x</div><div style="display: none">y</div>z') == ["z"]
    assert blocks("<ul><li>m<li>n</ul><table><tr><td>1<td>2</table>") == ["m", "n", "1", "2"]
    assert html_extract.host_of("https://u@A.example.org:80/x?y") == "a.example.org" and html_extract.host_of(None) == ""


def test_host_boilerplate(spark, monkeypatch):
    """Without markup to tell, what a host repeats on many pages goes; mirrors, other hosts and rare repeats stay."""
    rng = random.Random(10)
    notice, shared, mirror = sentence(rng, 25), sentence(rng, 25), sentence(rng, 120)
    rows = [(k, f"http://a.org/{k}", f"<p>{notice}</p><p>{sentence(rng, 60)}</p>" + (f"<p>{shared}</p>" if k < 3 else "")) for k in range(30)]
    rows += [(100 + k, f"http://b.org/{k}", f"<p>{sentence(rng, 60)}</p><p>{notice}</p>") for k in range(4)]
    rows += [(200 + k, "http://c.org/", f"<p>{mirror}</p>") for k in range(20)] + [(300, None, None), (None, "http://a.org", "<p>null</p>"), (301, "http://a.org", ""), (301, "http://a.org", "<p>again</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("tag", F.lit("x")).withColumn("spans", F.lit("y"))
    found = {(r.page_id, r.text): r for r in html_extract.extract(pages).collect()}
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found.values())
    texts = {k: t for k, t in found}
    assert all(notice not in texts[k] and len(texts[k].split()) >= 60 for k in range(30)) and all(shared in texts[k] for k in range(3))
    assert all(notice in texts[100 + k] for k in range(4)) and all(texts[200 + k] == mirror for k in range(20))
    assert (300, "") in found and (None, "null") in found and (301, "") in found and (301, "again") in found
    assert html_extract.extract(pages.limit(0)).count() == 0
