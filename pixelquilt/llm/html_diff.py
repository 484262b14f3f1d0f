"""Main text of web pages: block structure, then differencing against the nearest page of the same host.

Blocks. One pass over the tags cuts a page into text blocks and marks those that its elements name as no content:
styles, forms, menus, headers, footers, sidebars, notices, adverts and reader comments (scripts are no text at all). If
the page has an article (else a main element), its blocks are the candidates for the text, otherwise all blocks.

Differencing. Pages stand in the order of host and URL path; neighbouring copies (equal blocks) are one. Of the two
neighbours on the same host the one whose path agrees longest is the nearest. All blocks of both pages, marked ones
too, are aligned by longest common subsequence, and shared lines are deleted, with two restraints. A line that the host
has on most of its different pages (five at least, and half of them) is template and goes wherever it stands, also
inside an article. Any other shared line inside an article or main element stays if it is not mostly links, for
articles quote each other. And a neighbour that shares four fifths of what is not template is a copy; then the other neighbour
decides, and without one only template goes.

A host may hold any share of the pages: the order is cut into ranges at keys taken from a small sample, and the pages
at the borders also go to the neighbouring range. Template lines are counted over all pages of a host; as each stands on
half of its pages, a host has at most twice as many as a page has lines, and they go to the ranges of the host.

A run of neighbouring copies that fills a whole range has no different page in sight there; then only template goes
from it.

Defined results: NULL or empty html gives empty text; a NULL url or one without host has no neighbour; unclosed, cut
off and stray tags are tolerated; repeated rows are copies of each other and keep their text.
"""
from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import stash
from .text import documents, slices
from .url_rules import host, path

SAMPLE = 8              # sampled keys per range
COPY_SHARE = 0.8        # share of a page's text besides template that makes its neighbour a copy
TEMPLATE_PAGES = 5      # least number of different pages of a host that share a template line
TEMPLATE_SHARE = 0.5    # least share of them
LINK_SHARE = 0.5        # share of link text that makes a block a menu
TABLE_BITS = 1 << 28    # largest alignment table that is kept at once

# Element and attribute names
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption "
            "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
            "option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
DROPPED = set("nav footer aside form button select dialog menu search fieldset".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar".split())
DROPPED_WORDS = set("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies "
                    "consent gdpr notice notices alert popup modal overlay sidebar aside widget widgets menu nav navbar "
                    "navigation breadcrumb breadcrumbs masthead footer comment comments disqus reply replies respond share "
                    "sharing social related recommended newsletter subscribe subscription signup login pagination pager "
                    "toolbar copyright skip".split())
WRAPPER_WORDS = {"has", "with", "no", "layout", "wrapper"}
CONTENT = {"article", "main"}
OPEN, PROTECTED, MARKED = 0, 1, 2       # kinds of blocks: may go if shared, goes only as template, goes anyway
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"},
                  "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|noscript|textarea|title|svg|math|iframe|object|canvas)\b[^>]*+>.*?(?:</(?P=raw)\b[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?", re.I)


def _marked(attrs: str, inside_content: bool) -> bool:
    """Whether attributes mark an element as no content."""
    words: set[str] = set()
    for name, *values in ATTRIBUTE.findall(attrs):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name in ("class", "id"):
            words.update(w for part in value.split() for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", part).lower()))
        elif name == "role" and value.lower() in DROPPED_ROLES or name == "hidden":
            return True
        elif name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    if words & WRAPPER_WORDS:
        return False
    return bool(words & DROPPED_WORDS) or "header" in words and not inside_content


class Blocks:
    """The text blocks of one page: (text, place, kind); place 0 article, 1 main, 2 elsewhere."""

    def __init__(self, page: str):
        self.found: list[tuple[str, int, int]] = []
        self.stack: list[tuple[str, bool]] = []     # open elements: name, dropped
        self.open: dict[str, int] = {}
        self.dropped = 0
        self.parts: list[str] = []
        self.link_parts: list[str] = []
        self.marked_parts: list[str] = []
        at = 0
        for m in TOKEN.finditer(page):
            self._text(page[at:m.start()])
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                continue
            if name in BLOCK:
                self._flush()
            if m["end"]:
                self._close(name)
            else:
                self._start(name, m["attrs"])
        rest = page[at:]
        self._text(rest)
        self._flush()

    def _text(self, text: str) -> None:
        if text and self.dropped:
            self.marked_parts.append(text)
        elif text:
            self.parts.append(text)
            if self.open.get("a"):
                self.link_parts.append(text)

    def _flush(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                links = sum(map(len, self.link_parts))
                inside = 0 if self.open.get("article") else 1 if self.open.get("main") else 2
                self.found.append((text, inside, PROTECTED if inside < 2 and links < LINK_SHARE * sum(map(len, self.parts)) else OPEN))
        if self.marked_parts:
            text = " ".join(entities.unescape("".join(self.marked_parts)).split())
            if text:
                self.found.append((text, 2, MARKED))
        self.parts, self.link_parts, self.marked_parts = [], [], []

    def _start(self, name: str, attrs: str) -> None:
        if name in VOID or attrs.endswith("/") and name not in BLOCK:
            return
        if name in BLOCK and self.open.get("p"):
            self._close("p")
        if name in CLOSED_BY_SAME and self.open.get(name):
            for other, _ in reversed(self.stack):
                if other == name:
                    self._close(name)
                if other == name or other in CLOSED_BY_SAME[name]:
                    break
        content = bool(self.open.get("article") or self.open.get("main"))
        drop = name in DROPPED or name == "header" and not content or (
            name not in ("html", "body", "main") and bool(attrs) and _marked(attrs, content))
        self.stack.append((name, drop))
        self.open[name] = self.open.get(name, 0) + 1
        self.dropped += drop

    def _close(self, name: str) -> None:
        if not self.open.get(name):
            return
        while True:
            other, drop = self.stack.pop()
            self.open[other] -= 1
            self.dropped -= drop
            if other == name:
                return

    def lines(self) -> tuple[list[str], list[int]]:
        """All blocks and their kinds; blocks beside the article (else the main element) are marked as well."""
        best = min((p for _, p, kind in self.found if kind != MARKED), default=2)
        return [t for t, _, _ in self.found], [kind if p == best else MARKED for _, p, kind in self.found]


def common(a: list, b: list) -> list[int]:
    """Places in `a` of a longest common subsequence of a and b.

    Bit vectors over b, one per element of a; beyond TABLE_BITS the problem is halved (the best cut of b for the two
    halves of a), so memory stays bounded."""
    shared = set(a) & set(b)
    ia, ib = [i for i, x in enumerate(a) if x in shared], [j for j, x in enumerate(b) if x in shared]
    return [ia[i] for i in _aligned([a[i] for i in ia], [b[j] for j in ib])]


def _rows(a: list, b: list) -> Iterator[int]:
    """Per element of a: bits over b that are 0 where the length of the subsequence grows."""
    match: dict = {}
    for j, x in enumerate(b):
        match[x] = match.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & match.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _aligned(a: list, b: list) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > TABLE_BITS and len(a) > 1:
        half = len(a) // 2

        def lengths(x, y):
            last = (1 << len(y)) - 1
            for last in _rows(x, y):
                pass
            out = [0]
            for j in range(len(y)):
                out.append(out[-1] + (not last >> j & 1))
            return out

        left, right = lengths(a[:half], b), lengths(a[half:][::-1], b[::-1])[::-1]
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[j])
        return _aligned(a[:half], b[:cut]) + [half + i for i in _aligned(a[half:], b[cut:])]
    table, i, j, out = list(_rows(a, b)), len(a), len(b), []
    while i and j:
        if table[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if i and not table[i - 1] >> (j - 1) & 1:
            continue
        j -= 1
        out.append(i)
    return out[::-1]


def shared_lines(ids: list[int], sizes: list[int], kinds: list[int], neighbours: list[list[int]], template: set[int]) -> set[int]:
    """Places of the lines that differencing deletes, by the first neighbour (nearest first) that is no copy."""
    total = sum(n for x, n, k in zip(ids, sizes, kinds) if x not in template and k != MARKED)
    gone: set[int] = set()
    for place, other in enumerate(neighbours):
        shared = common(ids, other)
        if not place:
            gone = {i for i in shared if ids[i] in template}
        if sum(sizes[i] for i in shared if ids[i] not in template and kinds[i] != MARKED) < COPY_SHARE * max(total, 1):
            return {i for i in shared if ids[i] in template or kinds[i] != PROTECTED}
    return gone


def _ids(lines: list[str]) -> list[int]:
    """64-bit hashes of the lines, signed."""
    return [(h ^ 1 << 63) - (1 << 63) for h in (xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines)]


def templates(keyed: DataFrame) -> DataFrame:
    """host, template: the lines (as hashes) that most different pages of a host share."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", rows=256, mb=4):
            lines = [sorted(set(_ids(Blocks(h).lines()[0]))) if h else [] for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(lines, pa.list_(pa.int64()))], ["host", "lines"])

    found = keyed.where("host <> ''").select("host", "html").mapInArrow(parse, "host string, lines array<bigint>")
    pages = stash(found.groupBy("host", F.xxhash64("lines").alias("page")).agg(F.first("lines").alias("lines")), "page_lines")     # different pages
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= TEMPLATE_PAGES)
    often = (pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") >= TEMPLATE_PAGES).join(sizes, "host").where(F.col("n") >= TEMPLATE_SHARE * F.col("pages")))
    return often.groupBy("host").agg(F.array_sort(F.collect_list("line")).alias("template"))     # twice the lines of a page at most


def _agreement(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


KEY = ["host", "path", "tie"]


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(batch.column(c).to_pylist() for c in KEY)))


def _ranges(keyed: DataFrame) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """(first keys of the ranges after the first, further ranges of the pages at the borders)."""
    spark = keyed.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = keyed.select(*KEY)
    step = max(1, keys.count() // (SAMPLE * parts))
    sample = sorted(tuple(r) for r in keys.where(F.pmod(F.xxhash64("tie"), F.lit(step)) == 0).collect())  # about SAMPLE * parts
    cuts = sorted(set(sample[SAMPLE::SAMPLE]))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple] = {}
        for batch in batches:
            for key in _keys(batch):
                i = bisect.bisect_right(cuts, key)
                lo, hi = seen.get(i, (key, key))
                seen[i] = min(lo, key), max(hi, key)
        rows = [(i, *k) for i, pair in seen.items() for k in pair]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.string(), pa.string(), pa.int64()])],
                                             ["block", *KEY])

    ends = (keys.mapInArrow(block, "block int, host string, path string, tie long").groupBy("block")
            .agg(F.min(F.struct(*KEY)).alias("lo"), F.max(F.struct(*KEY)).alias("hi")).orderBy("block").collect())
    further: dict[tuple, list[int]] = {}
    for one, two in zip(ends, ends[1:]):
        if one["hi"]["host"] == two["lo"]["host"]:
            further.setdefault(tuple(one["hi"]), []).append(two["block"])
            further.setdefault(tuple(two["lo"]), []).append(one["block"])
    return cuts, further


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; n_shared lines that differencing deleted, n_template of them template,
    n_open of them not named as boilerplate by the tags."""
    kinds = dict(pages.dtypes)
    keyed = documents(pages, "page_id", "url", "html").select(
        "page_id", "url", "html", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
        F.xxhash64("page_id", "url").alias("tie"))
    cuts, further = _ranges(keyed)
    shape = (f"block int, first boolean, context boolean, page_id {kinds['page_id']}, url string, host string, path string, tie long, "
             "ids array<bigint>, sizes array<int>, kinds array<int>, lines array<string>")
    columns = ["block", "first", "context", "page_id", "url", *KEY, "ids", "sizes", "kinds", "lines"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", rows=256, mb=4):
            got = [Blocks(h).lines() if h else ([], []) for h in batch.column("html").to_pylist()]
            keys = _keys(batch)
            rows = [(bisect.bisect_right(cuts, k), False, i) for i, k in enumerate(keys)]
            rows += [(b, True, i) for i, k in enumerate(keys) for b in further.get(k, [])]
            block, context, at = zip(*rows)
            picked = batch.take(pa.array(at))
            # of marked lines only the hashes travel, of pages at the borders too
            texts = [[] if c else [x if k != MARKED else None for x, k in zip(*got[i])] for i, c in zip(at, context)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block, pa.int32()), pa.array([False] * len(at)), pa.array(context), *(picked.column(c) for c in ["page_id", "url", *KEY]),
                 pa.array([_ids(got[i][0]) for i in at], pa.list_(pa.int64())), pa.array([list(map(len, got[i][0])) for i in at], pa.list_(pa.int32())),
                 pa.array([got[i][1] for i in at], pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string()))], columns)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("host").to_pylist()
            rows = [(b, i) for i, h in enumerate(names) for b in range(bisect.bisect_right(cuts, (h,)), bisect.bisect_right(cuts, (h, "\U0010ffff" * 9)) + 1)]
            block, at = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), batch.column("host").take(pa.array(at)), batch.column("template").take(pa.array(at))],
                                             ["block", "host", "ids"])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = current = None                     # runs of neighbouring copies
        template: tuple = (None, frozenset())       # (block and host, lines)

        def near(a, b):
            return a is not None and b is not None and a["at"] == b["at"] and a["at"][1] != ""

        def result(run, after):
            page, around = run["page"], []
            if near(run, before):
                around.append((-_agreement(run["from"], before["to"]), before))
            if near(run, after):
                around.append((-_agreement(run["to"], after["from"]), after))
            known = template[1] if template[0] == run["at"] else frozenset()
            gone = shared_lines(page["ids"], page["sizes"], page["kinds"], [r["page"]["ids"] for _, r in sorted(around, key=lambda x: x[0])], known)
            text = " ".join(x for i, x in enumerate(page["lines"]) if x is not None and i not in gone)
            shares = (len(gone), sum(page["ids"][i] in known for i in gone), sum(page["kinds"][i] != MARKED for i in gone))
            return [(page_id, url, text, len(text), *shares) for page_id, url in run["members"]]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), *(pa.array([r[1 + i] for r in rows], pa.string()) for i in range(2)),
                                               *(pa.array([r[3 + i] for r in rows], pa.int64()) for i in range(4))],
                                              ["page_id", "url", "text", "n_chars", "n_shared", "n_template", "n_open"])

        for batch in slices(batches, "lines", rows=256, mb=4):
            id_type, rows = batch.schema.field("page_id").type, []
            for page in batch.to_pylist():
                at = (page["block"], page["host"])
                if current is not None and (page["first"] or at != current["at"] or page["ids"] != current["page"]["ids"]):
                    rows += result(current, None if page["first"] else {"at": at, "from": page["path"], "page": page})
                    before, current = current, None
                if page["first"]:
                    template = (at, frozenset(page["ids"]))
                    continue
                if current is None:
                    current = {"at": at, "from": page["path"], "page": page, "members": []}
                current["to"] = page["path"]
                if not page["context"]:
                    current["members"].append((page["page_id"], page["url"]))
                    if not current["page"]["lines"]:
                        current["page"] = page
            if rows:
                yield packed(rows)
        if current is not None and current["members"]:
            yield packed(result(current, None))

    heads = templates(keyed).mapInArrow(dealt, "block int, host string, ids array<bigint>").withColumns({"first": F.lit(True), "context": F.lit(True)})
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (keyed.mapInArrow(parse, shape).unionByName(heads, allowMissingColumns=True).repartition(parts, "block")
            .sortWithinPartitions("block", "host", F.col("first").desc(), "path", "tie", "context")
            .mapInArrow(differ, f"page_id {kinds['page_id']}, url string, text string, n_chars long, n_shared long, n_template long, n_open long"))
