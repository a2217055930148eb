"""Boilerplate that a host repeats, where the markup doesn't tell it, against brute force and case by case."""

import random
from collections import defaultdict

from tests.llm.conftest import sentence
from veilspark.llm import html_extract as he


def brute(rows):
    """rows: (page_id, url, html). Text of each page, by comparing all windows and short blocks."""
    streams = [[b.split(" ") for b in he.page_blocks(x or "")] for _, _, x in rows]
    hosts = [he.host_of(u) for _, u, _ in rows]

    def pieces(blocks):
        tokens, at = [t for b in blocks for t in b], 0
        yield from ((tuple(tokens[k : k + he.LENGTH]), k, k + he.LENGTH) for k in range(len(tokens) - he.LENGTH + 1))
        for b in blocks:
            if len(b) < he.LENGTH:
                yield ("block", *b), at, at + len(b)
            at += len(b)

    distinct, holders = defaultdict(set), defaultdict(set)
    for host, blocks in zip(hosts, streams, strict=True):
        one = tuple(map(tuple, blocks))
        distinct[host].add(one)
        for p, _, _ in pieces(blocks):
            holders[host, p].add(one)
    out = []
    for host, blocks in zip(hosts, streams, strict=True):
        pages, gone = len(distinct[host]), set()
        for p, a, e in pieces(blocks):
            if len(holders[host, p]) >= max(he.SHARE * pages, min(he.PAGES, max(he.FEW, pages / 2))):
                gone.update(range(a, e))
        out.append(" ".join(t for k, t in enumerate(t for b in blocks for t in b) if k not in gone))
    return out


def texts(spark, rows):
    found = he.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows)
    return {r.page_id: r.text for r in found}


def test_short_blocks_edits_small_hosts_and_mirrors(spark):
    rng = random.Random(20)
    p = lambda *blocks: "".join(f"<p>{b}</p>" for b in blocks)
    menu, line, left, right, long = [f"Go{k} there" for k in range(9)], "Copyright by us", sentence(rng, 20), sentence(rng, 20), sentence(rng, 200)
    body = {k: sentence(rng, 40) for k in range(200)}
    rows = [(k, "http://run.org", p(*menu, body[k])) for k in range(20)]
    rows += [(k, "http://alone.org", p(body[k], line, body[k + 100])) for k in range(20, 40)]
    rows += [(k, "http://date.org", p(f"{left} date{k} {right}", body[k])) for k in range(40, 60)]
    rows += [(k, "http://small.org", p(left, body[k])) for k in range(60, 66)]
    rows += [(k, "http://heavy.org", p(long, body[k])) for k in range(66, 86)]
    rows += [(k, "http://copies.org", p(left, body[86 if k < 92 else k])) for k in range(86, 106)]
    found = texts(spark, rows)
    assert all(found[k] == body[k] for k in [*range(20), *range(60, 86)])
    assert all(found[k] == f"{body[k]} {body[k + 100]}" for k in range(20, 40))
    assert all(found[k] == f"date{k} {body[k]}" for k in range(40, 60))
    assert all(found[k] == body[86 if k < 92 else k] for k in range(86, 106))


def test_windows_are_found_as_by_brute_force(spark):
    rng = random.Random(21)
    pool = [sentence(rng, rng.choice([1, 3, 8, 11, 12, 13, 30])) for _ in range(14)]

    def block():
        words = rng.choice(pool).split() if rng.random() < 0.7 else sentence(rng, rng.randint(1, 25)).split()
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        return " ".join(words)

    rows = [(k, f"http://h{rng.choice([0, 0, 0, 1, 1, 2, k])}.org/{k}", "".join(f"<p>{block()}</p>" for _ in range(rng.randint(0, 8)))) for k in range(150)]
    rows += [(150 + k, *rows[rng.randrange(150)][1:]) for k in range(40)] + [(200, None, None), (201, "http://h0.org", "")]
    expected = brute(rows)
    found = texts(spark, rows)
    assert [found[r[0]] for r in rows] == expected
    whole = [" ".join(he.page_blocks(r[2] or "")) for r in rows]
    assert sum(a != b for a, b in zip(whole, expected, strict=True)) > 30 and sum(map(bool, expected)) > 30


def test_attributes_and_articles():
    for page, text in {
        '<body class="page has-sidebar"><p>main text</p></body>': "main text",
        '<div class="content with-sidebar"><p>main text</p></div>': "main text",
        '<p title="the hidden valley">main text</p>': "main text",
        '<div data-hidden="false"><p data-id="comment">main text</p></div>': "main text",
        '<div id="social-history">main text</div>': "main text",
        '<div class="post">the story</div><article><p>and a teaser</p></article>': "the story and a teaser",
        '<div class="ad">x</div><div id="site-footer">x</div><ul class="comment-list"><li>x</ul><div class="ad-1">x</div>kept': "kept",
        "<div hidden>x</div><div class='a cookie-notice'>x</div><div role=navigation>x</div><p style='display: none'>x</p>kept": "kept",
        "<header>x</header><main><header>kept</header></main>": "kept",
    }.items():
        assert " ".join(he.page_blocks(page)) == text, page
