"""Main text of web pages by wrapper induction.

Pages of one host share a template, or one a layout.  Every page's DOM tree is
aligned with that of the host's first page, and of its layout's first page, by
simple tree matching (the largest order-preserving match of children below
matching parents).  An aligned node whose text is the
same on most pages is template; a slot whose text varies is content.  This
decides on every page, with landmarks or without.  Landmarks are evidence for
content alone: within an ``article`` or ``main`` element a sentence that many
pages quote stays, and what stands beside it is not lost.  Menus, adverts, forms
and the like, known by element or by class, are never content, though their text
may vary.

Template statistics cover all pages of all hosts, as sums per (host, reference, node).
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.columns import extended, record_batch, require
from marginalia.scratch import materialize

#: Reference pages are broadcast up to this many characters in all.
SMALL = 16 << 20
#: Pages of other layouts than their host's first may be broadcast up to this many (16 bytes each, beside the host).
FEW_PAGES = 200_000
#: Label paths in the sketch of a layout.
PATHS = 64

# HTML element names by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
SILENT = frozenset("script style noscript template svg head title nav footer aside form button select option textarea iframe object dialog menu audio video canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCKS - {"html", "body", "tbody", "tfoot", "thead", "tr"}
LANDMARKS = frozenset(["article", "main"])
#: What words of class, id and role never drop; nor do they drop what holds one of these.
HELD = LANDMARKS | {"html", "body"}
SIBLING = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Words of class, id and role that name what is not the main text.  A name is noise where all its words are: "cookie-notice", not "no-sidebar".
NOISE = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted promotion related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
_TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|([!?][^>]*)>?|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_OPEN = re.compile(r"<[/!?A-Za-z]")


class Element:
    __slots__ = ("tag", "label", "mark", "noisy", "parts", "children", "shape", "size", "own", "index")

    def __init__(self, tag: str, names: list[str], roles: list[str] = ()):
        self.tag = tag
        words = [_WORDS.findall(name) for name in names]
        self.label = (tag, frozenset(w for own in words for w in own))
        self.mark = tag in LANDMARKS or "main" in roles
        self.noisy = tag in SILENT or any(own and NOISE.issuperset(own) for own in words)
        self.parts: list = []  # texts and elements, in order
        self.children: list[Element] = []
        self.shape = 0
        self.size = 1
        self.own = ""
        self.index = -1


def parse(page: str) -> Element:
    """A forgiving DOM tree: unknown end tags are ignored, open elements end where they must."""
    root = Element("#root", [])
    stack, at, size = [root], 0, len(page)
    end = _OPEN.search(page, page.rfind(">") + 1)
    if end and not page.startswith("<!--", end.start()):
        page = page[: end.start()]  # a tag that never ends
        size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        if m[4] is None:
            continue
        tag = m[4].lower()
        if m[3]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCKS:
                    break
        if tag in SIBLING:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag or (tag in ("dt", "dd") and stack[k].tag in ("dt", "dd")) or (tag in ("td", "th") and stack[k].tag in ("td", "th")):
                    del stack[k:]
                    break
                if stack[k].tag in SIBLING[tag]:
                    break
        names: list[str] = []
        roles: list[str] = []
        if m[5] and "=" in m[5]:
            for kind, x, y, z in _NAMES.findall(m[5]):
                found = (x or y or z).lower().split()
                names += found
                if kind.lower() == "role":
                    roles += found
        e = Element(tag, names, roles)
        stack[-1].parts.append(e)
        stack[-1].children.append(e)
        if tag in VOID or m[5].endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            stop = close.start() if close else size
            e.parts.append(page[at:stop])
            gt = page.find(">", stop) if close else -1
            at = gt + 1 if gt >= 0 else size
            continue
        stack.append(e)
    _finish(root)
    return root


def _finish(root: Element) -> None:
    """Numbers, shapes and own texts, without recursion: pages may nest without bound."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        e.index = len(order)
        order.append(e)
        todo += reversed(e.children)
    held = [False] * len(order)
    for e in reversed(order):
        held[e.index] = e.mark or e.tag in HELD or any(held[c.index] for c in e.children)
        if held[e.index]:
            e.noisy = e.tag in SILENT
        e.shape = hash((e.label, tuple(c.shape for c in e.children)))
        e.size = 1 + sum(c.size for c in e.children)
        e.own = " ".join("".join(x for x in e.parts if isinstance(x, str)).split())


def align(a: Element, b: Element) -> list[tuple[Element, Element]]:
    """Simple tree matching: pairs of the largest top-down, order-preserving match.

    Without recursion, so the depth of a page is not bounded.
    """
    pairs: list[tuple[Element, Element]] = []
    if a.label != b.label:
        return pairs
    sizes: dict[tuple[int, int], int] = {}
    _measure(a, b, sizes)
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        todo += _children(x.children, y.children, sizes)
    return pairs


def _known(a: Element, b: Element, sizes: dict[tuple[int, int], int]) -> int | None:
    """Size of the match of two subtrees, 0 where the labels differ; None where it is still to be measured."""
    if a.label != b.label:
        return 0
    if a.shape == b.shape:
        return a.size
    if not a.children or not b.children:
        return 1
    return sizes.get((a.index, b.index))


def _measure(a: Element, b: Element, sizes: dict[tuple[int, int], int]) -> None:
    """Fill ``sizes`` for all pairs of subtrees that the match of two trees may ask for, the deepest first."""
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if _known(x, y, sizes) is not None:
            todo.pop()
            continue
        lo, n, m = _trimmed(x.children, y.children)
        lacking = [(p, q) for p in x.children[lo:n] for q in y.children[lo:m] if _known(p, q, sizes) is None]
        if lacking:
            todo += lacking
            continue
        sizes[x.index, y.index] = 1 + sum(_known(p, q, sizes) for p, q in _children(x.children, y.children, sizes))
        todo.pop()


def _trimmed(left: list[Element], right: list[Element]) -> tuple[int, int, int]:
    """First place, and end on either side, of what is left when equal shapes at both ends are taken off."""
    lo, n, m = 0, len(left), len(right)
    while lo < min(n, m) and left[lo].shape == right[lo].shape:
        lo += 1
    while n > lo and m > lo and left[n - 1].shape == right[m - 1].shape:
        n, m = n - 1, m - 1
    return lo, n, m


def _children(left: list[Element], right: list[Element], sizes: dict[tuple[int, int], int]) -> list[tuple[Element, Element]]:
    """The best pairing of two lists in order; equal shapes at either end pair at once."""
    lo, n, m = _trimmed(left, right)
    out = [*zip(left[:lo], right[:lo], strict=True), *zip(left[n:], right[m:], strict=True)]
    a, b = left[lo:n], right[lo:m]
    if a and b:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            row, above = best[i], best[i - 1]
            for j, y in enumerate(b, 1):
                gain = _known(x, y, sizes)
                row[j] = max(above[j], row[j - 1], above[j - 1] + gain if gain else 0)
        i, j = len(a), len(b)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((a[i], b[j]))
    return out


def main_text(root: Element, template: set[int]) -> str:
    """Blocks of the content in page order; ``template``: indexes of this page's template nodes."""
    blocks: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            blocks.append(text)

    # (element, whether inside a landmark, whether leaving)
    stack: list[tuple[object, bool, bool]] = [(root, False, False)]
    while stack:
        item, inside, leaving = stack.pop()
        if isinstance(item, str):
            if inside:
                buffer.append(item)
            continue
        e = item
        if leaving:
            flush()
            continue
        block = e.tag in BLOCKS
        if block:
            flush()
            stack.append((e, inside, True))
        elif e.tag in ("br", "td", "th", "img"):
            buffer.append(" ")
        if e.noisy or (e.tag == "header" and not inside):
            continue
        within = inside or e.mark
        shown = within or e.index not in template
        for x in reversed(e.parts):
            stack.append((x, within if isinstance(x, Element) else shown, False))
    flush()
    return "\n\n".join(blocks)


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]*)", 1), F.lit("")))
    return pages.withColumn("__host", host)


def paths(root: Element) -> list[int]:
    """A bounded sketch of a page's layout: the least hashes of the distinct label paths, alike on every worker."""
    known: dict[tuple[int, str, frozenset[str]], int] = {}
    found, todo = set(), [(root, 0)]
    while todo:
        e, above = todo.pop()
        key = (above, *e.label)
        if key not in known:
            known[key] = int.from_bytes(hashlib.blake2b(f"{above} {e.tag} {sorted(e.label[1])}".encode(), digest_size=7).digest(), "big")
        found.add(known[key])
        todo += [(c, known[key]) for c in e.children]
    return sorted(found)[:PATHS]


def _layouts(rows: DataFrame) -> DataFrame:
    """__host, __code, __leader: pages (by hash) whose layout is not their host's first page's, and the page they follow.

    Pages whose sketches agree in half of their paths are of one layout.  Rounds
    take twice as many of a host's least uncovered pages as the one before, until
    every page follows one: no layout is left out.
    """
    schema = pa.schema([("__paths", pa.list_(pa.int64()))])
    size = F.struct("page_id", F.length("html").alias("n"), "__code")
    keyed = rows.filter(F.length("html") > 0).select("__host", "html", size.alias("at"), "__code")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = record_batch(schema, [[paths(parse(page)) for page in batch.column(1).to_pylist()]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), made.column(0)], names=["__host", "at", "__code", "__paths"])

    drawn = keyed.drop("html")
    sketched = keyed.mapInArrow(sketch, extended(drawn, "__paths array<long>"))
    pages = materialize(sketched.groupBy("__host", "__code", "__paths").agg(F.min("at").alias("at")), "html-layouts")
    shapes = pages.groupBy("__host", "__paths").agg(F.min("at").alias("at"))
    least = F.slice(F.array_sort(F.array_union("__paths", "__theirs")), 1, PATHS)
    alike = F.size(F.array_intersect(F.array_intersect(least, "__paths"), "__theirs")) >= 0.5 * F.size(least)
    left, followed, take = materialize(shapes, "html-shapes"), None, 1
    while not left.isEmpty():
        order = F.row_number().over(Window.partitionBy("__host").orderBy("at"))
        leaders = left.withColumn("k", order).filter(F.col("k") <= take).select("__host", F.col("at").alias("leader"), F.col("__paths").alias("__theirs"))
        near = left.join(leaders, "__host").filter(alike).groupBy("__host", "__paths").agg(F.min("leader").alias("leader"))
        met = materialize(near, "html-met")
        if take > 1:
            followed = met if followed is None else followed.unionByName(met)
        left = materialize(left.join(met, ["__host", "__paths"], "left_anti"), "html-left")
        take *= 2
    if followed is None:
        return pages.limit(0).select("__host", "__code", F.col("__code").alias("__leader"))
    return materialize(pages.join(followed, ["__host", "__paths"]).select("__host", "__code", F.col("leader.__code").alias("__leader")).distinct(), "html-followed")


def extract(pages: DataFrame, share: float = 0.5, least: int = 3) -> DataFrame:
    """Add ``text`` to every page: page_id, url and html are read, all columns but ``text`` stay.

    A null or empty html gives an empty text; a null url belongs to a host
    without a name.  Every page is aligned with its host's first page and, where
    its layout is another, with the first page of that layout too.  A node is
    template where it has a reference's text on ``share`` of the other pages
    aligned with it, ``least`` of them at the least; copies of the reference page
    are no evidence.  Repeated rows are extracted each.
    """
    require(pages, "page_id", "url", "html")
    rows = _hosted(pages.select(*[c for c in pages.columns if c != "text"])).withColumn("__code", F.xxhash64("html"))
    full = rows.filter(F.length("html") > 0)
    layouts = _layouts(rows)
    few = F.broadcast if layouts.limit(FEW_PAGES + 1).count() <= FEW_PAGES else (lambda df: df)
    first = full.groupBy("__host").agg(F.min_by("html", F.struct("page_id", F.length("html"), "__code")).alias("__reference")).withColumn("__leader", F.lit(None).cast("long"))
    leaders = layouts.select("__host", F.col("__leader").alias("__code")).distinct()
    others = full.join(few(leaders), ["__host", "__code"]).groupBy("__host", F.col("__code").alias("__leader")).agg(F.min("html").alias("__reference"))
    references = materialize(first.unionByName(others), "html-references")
    size = references.agg(F.sum(F.length("__reference")).alias("n")).first()["n"] or 0
    hint = F.broadcast if size <= SMALL else (lambda df: df)
    trees: dict[str, Element] = {}

    def tree(reference: str) -> Element:
        if reference not in trees:
            if len(trees) >= 64:
                trees.clear()
            trees[reference] = parse(reference)
        return trees[reference]

    count_schema = pa.schema([("__host", pa.string()), ("__leader", pa.int64()), ("node", pa.int32()), ("met", pa.int64()), ("same", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int | None, int], list[int]] = {}
            for host, page, leader, reference in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if page == reference:
                    continue
                pairs = [(x.own == y.own, y.index) for x, y in align(parse(page), tree(reference)) if y.own]
                if all(equal for equal, _ in pairs):
                    continue
                for equal, node in pairs:
                    own = sums.setdefault((host, leader, node), [0, 0])
                    own[0] += 1
                    own[1] += equal
            keys = list(sums)
            yield record_batch(count_schema, [*([k[c] for k in keys] for c in range(3)), [v[0] for v in sums.values()], [v[1] for v in sums.values()]])

    firsts, seconds = references.filter(F.col("__leader").isNull()).drop("__leader"), references.filter(F.col("__leader").isNotNull())
    with_first = full.select("__host", "html").join(hint(firsts), "__host").select("__host", "html", F.lit(None).cast("long").alias("__leader"), "__reference")
    with_second = full.select("__host", "__code", "html").join(few(layouts), ["__host", "__code"]).join(hint(seconds), ["__host", "__leader"]).select("__host", "html", "__leader", "__reference")
    kind = "__host string, __leader long, node int, met long, same long"
    counted = with_first.mapInArrow(compare, kind).unionByName(with_second.mapInArrow(compare, kind))
    nodes = counted.groupBy("__host", "__leader", "node").agg(F.sum("met").alias("met"), F.sum("same").alias("same"))
    constant = nodes.filter((F.col("same") >= least) & (F.col("same") >= share * F.col("met"))).groupBy("__host", "__leader").agg(F.collect_list("node").alias("__template"))
    constant = constant.select(F.col("__host").alias("h"), F.col("__leader").alias("l"), "__template")
    own_key = (F.col("__host") == F.col("h")) & F.col("__leader").eqNullSafe(F.col("l"))
    wrappers = materialize(references.join(constant, own_key, "left").drop("h", "l"), "html-wrappers")
    out_schema_names: list[str] = [c for c in rows.columns if c not in ("__host", "__code")]
    used = ("html", "__reference", "__template", "__reference2", "__template2")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, *wrapped in zip(*(batch.column(c).to_pylist() for c in used), strict=True):
                if not page:
                    texts.append("")
                    continue
                root = parse(page)
                own: set[int] = set()
                for reference, template in (wrapped[:2], wrapped[2:]):
                    if template and reference:
                        listed = set(template)
                        own |= {x.index for x, y in align(root, tree(reference)) if y.index in listed and x.own == y.own}
                texts.append(main_text(root, own))
            arrays = [batch.column(c) for c in out_schema_names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string())], names=[*out_schema_names, "text"])

    useful = wrappers.filter(F.col("__template").isNotNull())
    firsts = useful.filter(F.col("__leader").isNull()).drop("__leader")
    seconds = useful.filter(F.col("__leader").isNotNull()).withColumnsRenamed({"__reference": "__reference2", "__template": "__template2"})
    matched = rows.join(hint(firsts), "__host", "left").join(few(layouts), ["__host", "__code"], "left").join(hint(seconds), ["__host", "__leader"], "left")
    return matched.mapInArrow(read, extended(rows.drop("__host", "__code"), "text string"))


def op7_htmltext(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    text = extract(pages.select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
