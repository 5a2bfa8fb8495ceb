"""Main text of web pages: block lines, then nearest-URL page differencing.

1. Each page becomes lines: one per block element, with character references decoded and white space folded.
   Elements that never are article text (menus, footers, forms, scripts, ...) are left out by tag or by class.
2. Pages are put in order by host, URL path and id. The keys alone are sorted first; keys at equal distances cut
   the order into blocks, so a host of any size is spread over as many tasks as it fills blocks. The pages' lines
   are then shuffled once, to their block, with the page on either side of each cut going to both blocks.
3. Every page is compared with the nearest page before and after it in its host: their lines are aligned by longest
   common subsequence, lines inside an article or main element with such lines and lines outside with those outside.
   Shared lines are deleted, but shared text stays: inside an article a prose line (``PROSE`` characters or more) or a
   sentence (measured: articles have them in common, and deleting them lost content), all of an article at least half of which is shared (a copy), and on a page without an article the prose lines, where
   at least half of the page's prose is shared.
4. Of a page that marks its article, lines outside it are left out, unless those that are its own hold more prose than
   the article has text: then the article is a teaser, and they are the main text.

Defined cases: null or empty html gives empty text; a null URL or one without ``://`` has no host and is not
paired; pages with equal host, path and lines are not paired with each other; repeated rows stay repeated rows; an empty
table gives no rows; of the input only page_id, url and html are read. A very long page is read whole; its lines are aligned
with a neighbour's in memory that grows with the product of their numbers of lines, in bits.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import cut_lineage
from lexiforge.llm.urls import parse_url

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)", re.S)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp"}
SKIP = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "object", "canvas", "audio", "video", "head"}
BLOCKS = set("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"br", "body", "html", "td", "th", "li", "dd", "dt", "tr", "option"}
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|banner|promo|sponsor(?:ed|s)?|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|widget|header|masthead|footer|comments?|commentlist|respond|disqus|replies|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|pagination|pager|toolbar|skip-link|copyright)(?:$|[\s_-])", re.I)
ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PROSE = 80  # characters of a line that is a paragraph rather than a label
SENTENCE = re.compile(r"[.!?…。！？][\"'»”’)\]]*$")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu", "menubar", "toolbar"}
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def unwanted(tag: str, attributes: str) -> str:
    """Why an element's whole content is left out: by "tag", "role" or "class", or "".

    ``header`` inside an article may hold the title, and a class name may stand for a wrapper; see block_lines.
    """
    if tag in SKIP:
        return "tag"
    if not attributes or tag in ("html", "body", "article", "main"):
        return ""
    why = "role" if HIDDEN.search(attributes) else ""
    for m in ATTR.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role" and value.lower() in ROLES:
            return "role"
        if m[1].lower() != "role" and NOISE.search(value):
            why = why or "class"
    return why


def block_lines(page: str) -> list[tuple[str, bool]]:
    """(line, whether it is inside an article or main element) of each block with text, in page order.

    An element with an unwanted class name stays if a main element is in it, or an article where no other article
    stands outside such elements (comments and cards are articles too): its class name then speaks of the layout.
    """
    lines, wrappers = _block_lines(page, frozenset())
    return _block_lines(page, wrappers)[0] if wrappers else lines


def _block_lines(page: str, spared: frozenset[int]) -> tuple[list[tuple[str, bool]], frozenset[int]]:
    """The lines, and where the elements begin that have to be spared from their class names."""
    lines: list[tuple[str, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each began an unwanted region
    classed: list[tuple[int, int]] = []  # of the open elements with an unwanted class name: depth and place
    around: dict[str, set[int]] = {"main": set(), "article": set()}
    free = False
    off = inside = at = 0

    def close_block() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                lines.append((text, inside > 0))

    def pop(to: int) -> None:
        nonlocal off, inside
        while len(stack) > to:
            tag, bad = stack.pop()
            off -= bad
            inside -= tag in ("article", "main")
        while classed and classed[-1][0] >= to:
            classed.pop()

    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            if not off:
                parts.append(page[at:])
            break
        if not off and m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing, attributes = m[2].lower(), bool(m[1]), m[3] or ""
        if tag in BLOCKS and not off:
            close_block()
        if closing:
            if tag == "p" and not any(t == "p" for t, _ in stack):
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if tag not in BLOCKS and stack[k][0] in BLOCKS:
                    break  # an inline end tag closes nothing beyond its block
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not attributes.rstrip().endswith("/"):
                at = end.end() if end else size
            continue
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        if tag in CLOSES_P:  # an open paragraph ends here
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if tag == "body":
            pop(0)
        why = unwanted(tag, attributes)
        bad = bool(why) and not (tag == "header" and inside) and m.start() not in spared
        if tag in around and off == len(classed):  # nothing but class names leaves it out
            around[tag].update(place for _, place in classed)
            free = free or not classed
        if bad and why == "class":
            classed.append((len(stack), m.start()))
        stack.append((tag, bad))
        off += bad
        inside += tag in ("article", "main")
    close_block()
    return lines, frozenset(around["main"] if free else around["main"] | around["article"])


def common_lines(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; equal ends first, then rows of bits for the middle."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    where: dict = {}
    for j, line in enumerate(y):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows, v = [full], full  # a zero bit at j: the length grows at column j
    for line in x:
        u = v & where.get(line, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    middle, i, j = [], len(x), len(y)
    length = lambda row, upto: upto - (rows[row] & ((1 << upto) - 1)).bit_count()
    while i and j and len(where):
        if x[i - 1] == y[j - 1]:
            middle.append((i - 1 + head, j - 1 + head))
            i, j = i - 1, j - 1
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1
    return [*((k, k) for k in range(head)), *middle[::-1], *((len(a) - tail + k, len(b) - tail + k) for k in range(tail))]


def keep_lines(page: tuple, before: tuple | None, after: tuple | None) -> list[str]:
    """The lines of ``page`` = (lines, inside flags) that are its own."""
    lines, flags = page
    marked = any(flags)
    # The text by which copies are judged: the article, or the prose of a page that marks none.
    text = {i for i, t in enumerate(lines) if (flags[i] if marked else len(t) >= PROSE)}
    length = lambda some: sum(len(lines[i]) for i in some)
    drop: set[int] = set()
    for other in (before, after):
        if other is None or other[0] == lines:
            continue
        shared = {i for i, _ in common_lines(list(zip(lines, flags, strict=True)), list(zip(*other, strict=True)))}
        copied = 2 * length(shared & text) >= length(text)
        drop |= {i for i in shared if i not in text or not (copied or (marked and (len(lines[i]) >= PROSE or SENTENCE.search(lines[i]))))}
    own = [i for i in range(len(lines)) if i not in drop]
    if marked and length(i for i in own if not flags[i] and len(lines[i]) >= PROSE) <= length(text):
        own = [i for i in own if flags[i]]
    return [lines[i] for i in own]


LINES = "block int, home boolean, host string, path string, page_id long, url string, lines array<string>, inside array<boolean>"
TEXT = "page_id long, url string, text string, n_chars long"
BATCH_ROWS = 256
Key = tuple[bool, bytes, bytes, bool, int]


def sort_key(host: str, path: str, page_id: int | None) -> Key:
    """The order in which Spark sorts (host, path, page_id): by bytes, nulls first."""
    return (True, host.encode("utf-8", "replace"), path.encode("utf-8", "replace"), page_id is not None, page_id or 0)


def batches_of(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)


def cut_order(keys: DataFrame, blocks: int) -> tuple[list[Key], list[Key]]:
    """The first key of every block but the first, and the last key of every block but the last."""
    names = ["host", "path", "page_id"]
    ordered = cut_lineage(keys.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = {r[0]: r[1] for r in ordered.groupBy(part.alias("p")).count().collect()}  # a number per partition
    total, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    if total < 2:
        return [], []
    step = max(1, -(-total // blocks))
    place = F.element_at(F.create_map(*[F.lit(v).cast("long") for pair in starts for v in pair]), part) + F.col("at").bitwiseAND((1 << 33) - 1)
    edges = ordered.withColumn("place", place).where(((F.col("place") % step == 0) & (F.col("place") > 0)) | ((F.col("place") % step == step - 1) & (F.col("place") < total - 1)))
    rows = edges.select(*names, "place").collect()  # two keys a block
    firsts = sorted(sort_key(r[0], r[1], r[2]) for r in rows if r["place"] % step == 0)
    lasts = sorted(sort_key(r[0], r[1], r[2]) for r in rows if (r["place"] + 1) % step == 0)
    return firsts, lasts


def extract_main_text(pages: DataFrame, blocks: int | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of ``pages(page_id, url, html)``; ``blocks`` defaults to four a shuffle partition."""
    spark = pages.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks or 4 * partitions
    host, path = parse_url(F.col("url"))
    firsts, lasts = cut_order(pages.select(host.alias("host"), path.alias("path"), "page_id"), blocks)
    schema = pa.schema([("block", pa.int32()), ("home", pa.bool_()), ("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("lines", pa.list_(pa.string())), ("inside", pa.list_(pa.bool_()))])
    text_schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, ends = set(firsts), set(lasts)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for h, p, page_id, url, page in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    got, key = block_lines(page or ""), sort_key(h, p, page_id)
                    rest = (h, p, page_id, url, [t for t, _ in got], [f for _, f in got])
                    block = bisect.bisect_right(firsts, key)
                    yield (block, True, *rest)
                    if key in starts:
                        yield (block - 1, False, *rest)
                    if key in ends:
                        yield (block + 1, False, *rest)

        return batches_of(rows(), schema)

    def difference(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = lambda a, b: b is not None and a["block"] == b["block"] and a["host"] == b["host"] != ""

        def rows() -> Iterator[tuple]:
            before = page = None
            for after in _rows(batches):
                if page is not None and page["home"]:
                    yield own(before, page, after)
                before, page = page, after
            if page is not None and page["home"]:
                yield own(before, page, None)

        def own(before: dict | None, page: dict, after: dict | None) -> tuple:
            sides = [(x["lines"], x["inside"]) if near(page, x) else None for x in (before, after)]
            text = "\n".join(keep_lines((page["lines"], page["inside"]), *sides))
            return page["page_id"], page["url"], text, len(text)

        return batches_of(rows(), text_schema)

    lines = pages.select(host.alias("host"), path.alias("path"), "page_id", "url", "html").mapInArrow(deal, LINES)
    return lines.repartition(partitions, "block").sortWithinPartitions("block", "host", "path", "page_id").mapInArrow(difference, TEXT)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield from batch.slice(at, BATCH_ROWS).to_pylist()


def op4_html_text(pages: DataFrame) -> DataFrame:
    return extract_main_text(pages)
