"""Main text of web pages, by page structure and repeated windows of each host's token streams.

A page becomes blocks of visible text. Elements for navigation, headers, footers, asides, forms, adverts, notices and
comments (by tag, role, or whole names in class and id) are out, and nothing else: text beside an article is kept, and
what classes of the page's frame (html, body, main, article) say counts for nothing.

Boilerplate that the markup doesn't tell is found by repetition. The tokens of a page are one stream across its blocks.
A window of ``LENGTH`` tokens is boilerplate if enough pages of the host hold it, and so is a whole block of fewer
tokens. Enough is ``SHARE`` of the host's pages and ``PAGES``; on a small host half of its pages do instead of
``PAGES``, if they are ``FEW``. The tokens that boilerplate covers go, unique runs stay, also within a block. Pages of a
host with equal streams are mirrors: they count as one page, so what only they share is not boilerplate.

1. Suffixes are taken at anchors (in each window the ``GRAM`` tokens with the least hash), keyed by host and leading
   tokens, dealt out in ranges by sampled splitters, sorted, and neighbours compared: equal ones are added up. Equal
   windows have equal anchors, so a window is on enough pages only if its anchor's key is.
2. The windows at such anchors are added up in the same way, each by itself: an edit next to a window doesn't hide it.
3. The windows of all pages are looked up in what was found. Steps 2 and 3, and what tells mirrors, read
   filters of fixed size, which let through some other keys too: those are counted, or joined, exactly like the rest.

Pages of one slice are counted before anything moves, so a footer on a third of all pages is one row for each slice.
Null html is empty; repeated and null page_ids are separate pages. A null url has the empty host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, column, hash_strings, key_filter, materialise, mix, signed, slices, texts_of, window_hashes
from .suffix_dedup import _window_min

#: Tokens of a window and of an anchor; pages and share of a host's pages for boilerplate.
LENGTH, GRAM = 12, 4
PAGES, SHARE = 8, 0.2
#: Fewest pages for boilerplate on hosts of fewer than twice ``PAGES``.
FEW = 5
SAMPLE_ROWS = 256
ROWS = "range int, h long, host long, n int"

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>)", re.S)
#: One attribute: its name, and its value in quotes of either kind or bare.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = frozenset("script style textarea title noscript iframe xmp template object svg math canvas audio video select noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT = frozenset("nav footer aside form button menu dialog head fieldset label".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"})}
BLOCKS = frozenset({"p"})
#: Whole names in class or id (parts joined by - or _ count as one name), and roles, that mark what is not the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus replies respond share sharing social related recommended widget login signup search "
    "pagination pager toolbar".split()
)
#: What may stand before or after such a name in a longer one: the whole still names the same kind of thing.
SIDES = frozenset("site page main top bottom left right header head foot global primary secondary mobile box bar block area list section wrapper wrap container inner outer content links link buttons button form item items group panel unit slot text row col".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Elements that hold the page or its article: what their class says is about the page's layout.
FRAMES = frozenset("html body main article".split())


def _named(item: str) -> bool:
    """Whether a class or an id is a name of what isn't the article: "ad", "site-footer", "comment-list", but not
    "social-history", "with-sidebar" or "no-comments"."""
    parts = [x for x in re.split(r"[-_]+", item) if x and not x.isdigit()]
    return any(x in NAMES for x in parts) and all(x in NAMES or x in SIDES for x in parts)


def _marks(attributes: str, name: str = "div") -> bool:
    """Whether attributes say that an element isn't part of the article. Names inside other attributes' values say nothing."""
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if name in FRAMES:
            continue
        if (key == "role" and value in ROLES) or (key in ("class", "id") and any(_named(x) for x in value.split())):
            return True
    return False


def page_blocks(page: str) -> list[str]:
    """Blocks of visible text of a page, outside of what its markup excludes."""
    found: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, out, in an article or main part
    out = inside = False
    parts: list[str] = []
    at = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                found.append(text)

    while True:
        m = TAG.search(page, at)
        if not out and (text := page[at : m.start() if m else len(page)]):
            parts.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name not in INLINE:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] in ("td", "th", "article", "main", "body") and name in ("p", "li"):
                    break
        else:
            if name in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
                continue
            if name in VOID:
                continue
            shuts = CLOSES.get(name) or (BLOCKS if name not in INLINE else None)
            if shuts and stack:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in shuts:
                        flush()
                        del stack[k:]
                    elif stack[k][0] not in INLINE:
                        break
                out, inside = stack[-1][1:] if stack else (False, False)
            excluded = name in OUT or (name == "header" and not inside) or (m[3] and _marks(m[3], name))
            held = (name, out or bool(excluded), inside or (name in ("article", "main") and not out and not excluded))
            if held[1] != out:
                flush()
            stack.append(held)
        now = stack[-1][1:] if stack else (False, False)
        if now[0] != out:
            flush()
        out, inside = now
    flush()
    return found


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return m[1].lower() if m else ""


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stream of each page (a line for each block), and fingerprints of its host and of both."""
    for b in slices(batches, "html"):
        stream = pa.array(["\n".join(page_blocks(t)) for t in texts_of(b, "html").to_pylist()], pa.string())
        host = hash_strings(pa.array([host_of(u) for u in column(b, "url").to_pylist()], pa.string()))
        yield pa.RecordBatch.from_arrays([column(b, "page_id"), column(b, "url"), stream, pa.array(signed(host)), pa.array(signed(mix(hash_strings(stream) + host, 8)))], names=["page_id", "url", "stream", "host", "print"])


def _tokens(streams: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All tokens of a slice, and of each the number of its page and of its block within the slice."""
    lists = pc.split_pattern(streams, "\n")
    blocks, of_page = lists.flatten(), np.repeat(np.arange(len(streams)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(blocks), 0)
    lists, of_page = pc.split_pattern(blocks.filter(full), " "), of_page[full.to_numpy(zero_copy_only=False)]
    block = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return lists.flatten(), of_page[block], block


def token_windows(page: np.ndarray, block: np.ndarray, keys: np.ndarray, host: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(h, w, first token, end) of the windows of all pages, and of their blocks that are shorter than a window: key of
    the anchor and of the window itself, and the tokens that it covers. A short block is its own anchor."""
    n = len(keys)
    head = np.flatnonzero(np.diff(block, prepend=-1))
    size = np.diff(np.append(head, n))
    short, size = head[size < LENGTH], size[size < LENGTH]
    start = np.flatnonzero(page[LENGTH - 1 :] == page[: max(0, n - LENGTH + 1)]) if n >= LENGTH else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        line = np.zeros(len(short), np.uint64)
        for k in range(LENGTH - 1):
            more = size > k
            line[more] = mix(line[more] * BASE + keys[short[more] + k], 6)
        line = mix(line + size.astype(np.uint64) + host[page[short]], 7)
        if not len(start):
            return line, line, short, short + size
        gram, whole = mix(window_hashes(keys, GRAM), 1), window_hashes(keys, LENGTH)
        anchor = (_window_min((gram >> np.uint64(32) << np.uint64(32)) | np.arange(len(gram), dtype=np.uint64), LENGTH - GRAM + 1)[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        own = host[page[start]]
        h, w = mix(gram[anchor] + own, 2), mix(mix(whole[start], 3) + own, 4)
    return np.concatenate([h, line]), np.concatenate([w, line]), np.concatenate([start, short]), np.concatenate([start + LENGTH, short + size])


def _windows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """h, w, first and end of :func:`token_windows`, and the page of each token."""
    tokens, page, block = _tokens(column(b, "stream"))
    coded = tokens.dictionary_encode()
    keys = hash_strings(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(tokens) else np.zeros(0, np.uint64)
    return *token_windows(page, block, keys, column(b, "host").to_numpy().view(np.uint64)), page


def _picked(b: pa.RecordBatch, mirrors, wanted: bool) -> pa.RecordBatch:
    """The pages that a filter of mirrors lets through, or the others."""
    return b.filter(pa.array(mirrors.value.passes( column(b, "print").to_numpy().view(np.uint64)) == wanted))


def _rows(splitters: np.ndarray, known=None, mirrors=None):
    """Anchors of each slice with the number of its pages that hold them; with a filter of anchors, their windows.
    Pages that pass a filter of mirrors are left to another call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "stream"):
            b = _picked(b, mirrors, False) if mirrors else b
            h, w, first, _, page = _windows(b)
            own = page[first]
            if known is not None:
                asked = known.value.passes(h)
                h, own = w[asked], own[asked]
            if not len(h):
                continue
            # the keys of a page are made distinct, then its pages are counted
            order = np.lexsort((own, h))
            h, own = h[order], own[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
            h, own = h[once], own[once]
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            n = np.diff(np.append(at, len(h)))
            yield pa.RecordBatch.from_pydict({"range": np.searchsorted(splitters, h[at]).astype(np.int32), "h": signed(h[at]), "host": column(b, "host").take(pa.array(own[at])), "n": n.astype(np.int32)})

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours that are equal, added up; the last row of a batch waits for the next one."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        h, host, n = (column(b, k).to_numpy().astype(np.int64) for k in ("h", "host", "n"))
        if held:
            h, host, n = (np.concatenate([[x], y]) for x, y in zip(held, (h, host, n), strict=True))
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        total = np.add.reduceat(n, at)
        held = (h[at[-1]], host[at[-1]], total[-1])
        at, total = at[:-1][total[:-1] >= FEW], total[:-1][total[:-1] >= FEW]
        yield pa.RecordBatch.from_pydict({"h": h[at], "host": host[at], "n": total})
    if held and held[2] >= FEW:
        yield pa.RecordBatch.from_pydict({k: [int(x)] for k, x in zip(("h", "host", "n"), held, strict=True)})


def _often(pages: DataFrame, again: DataFrame, mirrors, hosts: DataFrame, splitters: np.ndarray, name: str, known=None) -> DataFrame:
    """h of the anchors (of the windows, if a filter of anchors is known) that are on enough pages of their host.
    ``again``: one page of each group of mirrors."""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.mapInArrow(_rows(splitters, known, mirrors), ROWS).unionByName(again.mapInArrow(_rows(splitters, known), ROWS))
    runs = rows.repartition(parts, "range").sortWithinPartitions("h").mapInArrow(_runs, "h long, host long, n long")
    enough = F.greatest(SHARE * F.col("pages"), F.least(F.lit(float(PAGES)), F.greatest(F.lit(float(FEW)), F.col("pages") / 2)))
    return materialise(materialise(runs, f"html-{name}-runs").join(hosts, "host").where(F.col("n") >= enough).select("h"), f"html-{name}")


def boilerplate(pages: DataFrame) -> DataFrame:
    """h of the windows and short blocks that are boilerplate of their host; ``pages`` as :func:`extract` parses them."""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = pages.select("row", "stream", "host", "print")
    distinct = materialise(pages.groupBy("print").agg(F.min("row").alias("row"), F.min("host").alias("host"), F.count("*").alias("n")), "html-distinct")
    hosts = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    mirrors = key_filter(distinct.where("n > 1").select(F.col("print").alias("h")))
    passed = pages.mapInArrow(lambda batches: (_picked(b, mirrors, True) for b in batches), "row long, stream string, host long, print long")
    again = materialise(passed.join(distinct.select("row"), "row", "left_semi"), "html-again")
    sample = pages.limit(SAMPLE_ROWS).mapInArrow(_rows(np.zeros(0, np.uint64)), ROWS).select("h").toArrow()
    h = np.sort(sample.column("h").to_numpy().astype(np.int64).view(np.uint64))
    splitters = np.unique(h[np.linspace(0, len(h) - 1, 4 * parts + 1).astype(np.int64)[1:-1]]) if len(h) else h
    anchors = _often(pages, again, mirrors, hosts, splitters, "anchors")
    return _often(pages, again, mirrors, hosts, splitters, "windows", key_filter(anchors))


def _found(known):
    """The windows of all pages that a filter of the known ones lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "stream"):
            _, w, first, end, page = _windows(b)
            begin = np.searchsorted(page, np.arange(b.num_rows))
            at = np.flatnonzero(known.value.passes(w))
            own = page[first[at]]
            yield pa.RecordBatch.from_pydict({"h": signed(w[at]), "row": column(b, "row").take(pa.array(own)), "first": (first[at] - begin[own]).astype(np.int32), "end": (end[at] - begin[own]).astype(np.int32)})

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "stream"):
        out = []
        spans = column(b, "spans")
        for stream, cover in zip(column(b, "stream").to_pylist(), spans, strict=True):
            text = stream.replace("\n", " ")
            if len(cover):
                tokens = text.split(" ")
                first, end = (cover.values.field(k).to_numpy() for k in ("first", "end"))
                hit = np.cumsum(np.bincount(first, minlength=len(tokens) + 1) - np.bincount(end, minlength=len(tokens) + 1))
                text = " ".join(x for x, gone in zip(tokens, hit[:-1] > 0, strict=True) if not gone)
            out.append(text)
        text = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays([column(b, "page_id"), column(b, "url"), text, pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of ``pages`` (page_id, url, html)."""
    id_type = pages.schema["page_id"].dataType.simpleString()
    parsed = pages.select("page_id", "url", "html").mapInArrow(_parse, f"page_id {id_type}, url string, stream string, host long, print long")
    parsed = materialise(parsed.withColumn("row", F.monotonically_increasing_id()), "html-streams")
    known = boilerplate(parsed)
    rows = parsed.select("row", "stream", "host").mapInArrow(_found(key_filter(known)), "h long, row long, first int, end int")
    covered = materialise(rows.join(known, "h").groupBy("row").agg(F.collect_list(F.struct("first", "end")).alias("spans")), "html-spans")
    none = F.array().cast("array<struct<first:int,end:int>>")
    joined = parsed.join(covered, "row", "left")
    return joined.select("page_id", "url", "stream", F.coalesce("spans", none).alias("spans")).mapInArrow(_texts, f"page_id {id_type}, url string, text string, n_chars long")
