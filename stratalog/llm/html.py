"""HTML main-text extraction by consensus paths of each host."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm.shared import Workspace

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr".split()
)
#: A start tag of the key ends an open element of the values, up to the nearest container.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
CLOSABLE = frozenset({"p"}.union(*CLOSES.values()))
#: Elements beyond which a start tag ends nothing.
SCOPES = CONTAINERS | frozenset("ul ol table dl".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BOILERPLATE = frozenset("nav footer aside button select head title menu dialog object audio video canvas".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav\w*|breadcrumbs?|header|masthead|footer|notices?|cookies?|"
    r"consent|gdpr|alert|popup|modal|overlay|newsletter|subscri\w+|social|share|sharing|related|recommend\w*|comments?|disqus|repl(?:y|ies)|widgets?|"
    r"toolbar|login|signup|search|skip)(?:$|[\s_-])",
    re.I,
)
#: Class and id words that say how a page is laid out or what is switched on, and headings of an article; neither marks boilerplate.
LAYOUT = re.compile(
    r"(?<!\S)(?:has|no|with|without|hide|show)[_-]\S+|(?<!\S)\S+[_-](?:open|opened|closed|enabled|disabled)(?!\S)"
    r"|(?<!\S)(?:post|entry|article|story|content|title|headline)[_-]*header(?!\S)",
    re.I,
)
#: Elements of running text: in an article, one is marked only by a name that is a mark as a whole, or with a word that names a part of a page.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd dl ul ol blockquote pre figure figcaption table tr td th".split()) | INLINE
PARTS_OF_PAGE = frozenset("area bar block bottom box button buttons container content footer form icon icons inner item items label left line link links list message module note outer panel pane right row section slot text title top unit wrap wrapper".split())
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|repl(?:y|ies))(?:$|[\s_-])", re.I)
HEADER = re.compile(r"(?:^|(?<=[\s_-]))(?:header|masthead)(?=$|[\s_-])", re.I)
#: A marked element with at least this share of the page's unlinked text is its content; one around an article needs the lesser share.
MOST, SOME = 2 / 3, 1 / 4
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar".split())
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class Region:
    """An article, main or marked element of a page: what it stands in, and its text outside and inside links."""

    __slots__ = ("tag", "outer", "marked", "kept", "unlinked", "linked", "inside", "nested", "is_article", "replies", "around", "open", "above")

    def __init__(self, tag: str, outer: Region | None, marked: bool, readers: bool) -> None:
        self.tag, self.outer, self.marked, self.kept = tag, outer, marked, not marked
        self.unlinked = self.linked = self.above = 0
        nested = outer is not None and outer.nested
        self.nested = nested or tag == "article"
        self.inside = tag in ("article", "main") or (outer is not None and outer.inside)
        self.is_article = tag == "main" or (tag == "article" and not nested)
        #: Readers' own text under an article, which may be longer than it.
        self.replies = nested and (readers or tag == "article")
        self.around, self.open = False, True


def judge(regions: list[Region], unlinked: int) -> None:
    """Sets ``kept`` and ``open`` (all outer ones are kept) of regions, given in page order, of a page with so many
    characters outside links.

    Kept are an article that is in no other, an element with most of the page's text, and one around an article with some
    of it, as long as links are the lesser part of its text and no article that is shown stands outside it. An outer
    region is judged before those in it, so one walk inwards and one outwards do, however deep they are.
    """
    for r in reversed(regions):
        if r.outer:
            r.outer.unlinked += r.unlinked
            r.outer.linked += r.linked
            r.outer.around |= r.around or r.is_article
    walls: dict[Region, Region | None] = {}
    waiting: dict[Region, int] = defaultdict(int)
    shown = 0
    for r in regions:
        r.kept |= r.is_article
        wall = walls[r] = r if not r.kept else walls[r.outer] if r.outer else None
        if r.is_article and r.unlinked:
            if wall:
                waiting[wall] += 1
            else:
                shown += 1
    for r in regions:
        if r.outer:
            r.open = r.outer.open and r.outer.kept
            r.above = r.outer.above + (r.outer.is_article and r.outer.unlinked > 0)
        if r.kept or r.replies or r.linked > r.unlinked or not r.open or shown > r.above:
            continue
        r.kept = r.unlinked > 0 and r.unlinked >= (SOME if r.around else MOST) * unlinked
        shown += waiting[r] if r.kept else 0


def is_marked(label: str, inside: bool, textual: bool = False) -> bool:
    """Whether a class or id is on the list; in an article or main, a header is a headline's, as the element ``header`` is.

    A paragraph or other ``textual`` element there may be named for what it tells (side effects, a share price, an ad-hoc
    meeting): all words of a name must then be marks or parts of a page.
    """
    label = LAYOUT.sub(" ", label)
    if not inside:
        return bool(MARKED.search(label))
    label = HEADER.sub("", label)
    if not textual:
        return bool(MARKED.search(label))
    return any(MARKED.search(name) and all(not w or w in PARTS_OF_PAGE or w.isdigit() or MARKED.search(w) for w in re.split(r"[_-]", name.lower())) for name in label.split())


class Box:
    """A container of a page: its path, what it stands in, and the text of its own blocks, then of all in it."""

    __slots__ = ("tag", "path", "outer", "nested", "length", "linked", "worth", "own", "wanted")

    def __init__(self, segment: str, outer: Box | None) -> None:
        self.tag, self.outer = segment.partition(".")[0], outer
        self.path = inner_path(outer.path if outer else "", segment)
        #: Whether an article stands around it.
        self.nested = outer is not None and (outer.nested or outer.tag == "article")
        self.length = self.linked = 0
        self.worth = self.own = 0.0
        self.wanted = False


def inner_path(outer: str, segment: str) -> str:
    """The path of a container in one of path ``outer``: a digest of all tags and classes from the outside, and the last."""
    return f"{hashlib.blake2b(f'{outer}/{segment}'.encode('utf-8', 'replace'), digest_size=9).hexdigest()} {segment}"


def container_path(segments: str) -> str:
    """The path of the innermost of containers such as ``body/div.post``."""
    path = ""
    for segment in segments.split("/"):
        path = inner_path(path, segment)
    return path


Block = tuple[str, int, "Box | None"]


def read(page: str) -> tuple[list[Block], list[Box]]:
    """(text, link characters, container) of every block not in boilerplate, and all containers, outer ones first."""
    regions: list[Region] = []
    boxes: list[Box] = []
    found = list(_parts(page, regions, boxes))
    if any(r.marked for r in regions):
        judge(regions, sum(len(t.strip()) for parts, _ in found for t, in_link, _ in parts if not in_link))
    blocks = []
    for parts, box in found:
        shown = [(text, in_link) for text, in_link, region in parts if region is None or (region.open and region.kept)]
        text = " ".join(entities.unescape("".join(text for text, _ in shown)).split())
        if text:
            blocks.append((text, sum(len(text.strip()) for text, in_link in shown if in_link), box))
    return blocks, boxes


def blocks(page: str) -> list[Block]:
    return read(page)[0]


def _parts(page: str, regions: list[Region], boxes: list[Box]) -> Iterator[tuple[list[tuple[str, bool, Region | None]], Box | None]]:
    """Each block's pieces (text, in a link, innermost region) and innermost container; fills ``regions`` and ``boxes`` in
    page order.

    Open elements are found by tag in lists of places on the stack, so a tag costs the same however deep it stands.
    """
    stack: list[tuple[str, bool, Region | None, Box | None]] = []
    opens: dict[str, list[int]] = defaultdict(list)
    block_at: list[int] = []
    scopes: list[tuple[int, dict[str, list[int]]]] = [(-1, defaultdict(list))]
    parts: list[tuple[str, bool, Region | None]] = []
    region: Region | None = None
    box: Box | None = None
    skipped, in_link, at = 0, 0, 0

    def add(part: str) -> None:
        parts.append((part, in_link > 0, region))
        if region:
            if in_link:
                region.linked += len(part.strip())
            else:
                region.unlinked += len(part.strip())

    def push(tag: str, skip: bool) -> None:
        place = len(stack)
        stack.append((tag, skip, region, box))
        opens[tag].append(place)
        if tag not in INLINE:
            block_at.append(place)
        if tag in CLOSABLE:
            scopes[-1][1][tag].append(place)
        if tag in SCOPES:
            scopes.append((place, defaultdict(list)))

    def close(depth: int) -> None:
        nonlocal skipped, in_link, region, box
        while len(stack) > depth:
            tag, skip, region, box = stack.pop()
            opens[tag].pop()
            if tag not in INLINE:
                block_at.pop()
            if tag in SCOPES:
                scopes.pop()
            if tag in CLOSABLE:
                scopes[-1][1][tag].pop()
            skipped -= skip
            in_link -= tag == "a"

    for m in TOKEN.finditer(page):
        if m.start() > at and not skipped:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag not in INLINE and parts:
            yield parts, box
            parts = []
        if m["end"]:
            places = opens.get(tag)
            if places and not (tag in INLINE and block_at and block_at[-1] > places[-1]):
                close(places[-1])
            continue
        if tag in VOID:
            continue
        ends = CLOSES.get(tag, frozenset()) | ({"p"} if tag in CLOSES_P else frozenset())
        if ends:
            owner, inner = scopes[-1]
            depth = max((inner[t][-1] for t in ends if inner.get(t)), default=owner if owner >= 0 and stack[owner][0] in ends else -1)
            if depth >= 0:
                close(depth)
        named = {}
        if m["attrs"]:
            for a in ATTRIBUTE.finditer(m["attrs"]):
                named[a[1].lower()] = a[2] or a[3] or a[4] or ""
        label = named.get("class", "")
        inside = region is not None and region.inside
        skip = (
            tag in BOILERPLATE
            or (tag == "header" and not inside)
            or named.get("role", "").lower() in ROLES
            or "hidden" in named
            or named.get("aria-hidden") == "true"
            or "display:none" in named.get("style", "").replace(" ", "").lower()
        )
        textual = tag in TEXTUAL
        marked = tag not in ("html", "body", "main", "header") and (
            tag == "form" or is_marked(label, inside, textual) or is_marked(named.get("id", ""), inside, textual)
        )
        if not m["attrs"].endswith("/") or tag in CONTAINERS:
            push(tag, skip)
            if tag in CONTAINERS:
                general = ".".join(sorted(re.sub(r"\d+", "N", label.lower()).split()))
                box = Box(f"{tag}.{general}" if general else tag, box)
                boxes.append(box)
            if not skipped and not skip and (marked or tag in ("article", "main")):
                region = Region(tag, region, marked, bool(READERS.search(f"{label} {named.get('id', '')}")))
                regions.append(region)
            skipped += skip
            in_link += tag == "a"
    if at < len(page) and not skipped:
        add(page[at:])
    if parts:
        yield parts, box


#: An article stands for its page from this share of the page's text; a container below it is left for the one around.
ARTICLE_SHARE, HELD = 1 / 3, 1 / 2
#: Body is taken for containers in it alone only where they leave more than this share of its text out.
OUTSIDE = 1 / 5
#: Added text may have this share in links. A host's path is not read where it has less than this share of the page's own best.
LINKED, SMALL = 1 / 3, 1 / 3


class Container:
    """What stands in the containers of one path: characters, of them in links, and their worth, in all and in own blocks."""

    __slots__ = ("tag", "outer", "nested", "length", "linked", "own", "score", "worth")

    def __init__(self, tag: str = "", outer: str | None = None, nested: bool = False) -> None:
        self.tag, self.outer, self.nested = tag, outer, nested
        self.length = self.linked = 0
        self.worth = self.own = self.score = 0.0


def containers(found: list[Block], boxes: list[Box]) -> dict[str, Container]:
    """By path, those with text; the empty path has the whole page. A block's worth is its characters without links."""
    page = Container()
    by_path = {"": page}
    for text, links, box in found:
        worth = max(0.0, len(text) - 2.0 * links)
        for c in (page, box) if box else (page,):
            c.length += len(text)
            c.linked += links
            c.worth += worth
        (box or page).own += worth
    for box in reversed(boxes):
        if not box.length:
            continue
        up = box.outer.path if box.outer else ""
        if box.path not in by_path:
            by_path[box.path] = Container(box.tag, up, box.nested)
        if up not in by_path:
            by_path[up] = Container(box.outer.tag, box.outer.outer.path if box.outer.outer else "", box.outer.nested)
        c = by_path[box.path]
        c.length += box.length
        c.linked += box.linked
        c.worth += box.worth
        c.own += box.own
        c.score += box.own
        by_path[up].score += box.own / 2 if up else 0
        if box.outer:
            box.outer.length += box.length
            box.outer.linked += box.linked
            box.outer.worth += box.worth
    return by_path


def best_container(found: list[Block], boxes: list[Box]) -> tuple[str, float]:
    """Path and worth of the outermost container that has the page's text without its links; an empty path is the page.

    It starts at the best article, where that has a fair share of the text, or else at the container with most text in
    its own blocks and half as much for its children's, and goes outwards as long as unlinked text is added. An article
    or main that has most of the text around it is not left, but for a container that only adds blocks of its own, as a
    headline or a correction; nor is a container for a body that adds little beside it.
    """
    by_path = containers(found, boxes)
    page = by_path[""]
    inner = [p for p in by_path if p]
    if not inner:
        return "", page.worth
    outermost = [p for p in inner if by_path[p].tag == "article" and not by_path[p].nested]
    at = max(outermost, key=lambda p: (by_path[p].worth, p), default="")
    if not at or by_path[at].worth < ARTICLE_SHARE * page.worth:
        at = max(inner, key=lambda p: (by_path[p].score, p))
    path = by_path[at].outer
    while path is not None:
        here, there = by_path[at], by_path[path]
        added = there.worth - here.worth
        if added > 0:
            if there.linked - here.linked > LINKED * (there.length - here.length):
                break
            beside = there.tag not in ("", "body") and added <= there.own + 1e-6
            if here.tag in ("article", "main") and here.worth >= HELD * there.worth and not beside:
                break
            if there.tag in ("", "body") and not there.own and added <= OUTSIDE * there.worth:
                break
            at = path
        path = there.outer
    return at, by_path[at].worth


def main_text(page: str, wanted: str | None) -> str:
    """Blocks of all containers on the path ``wanted``; of the page's best container, where they have little beside it."""
    found, boxes = read(page)
    best, worth = best_container(found, boxes)

    def held(path: str) -> list[Block]:
        for box in boxes:
            box.wanted = box.path == path or (box.outer is not None and box.outer.wanted)
        return [b for b in found if b[2] is not None and b[2].wanted]

    if wanted:
        here = held(wanted)
        if here and sum(max(0.0, len(text) - 2.0 * links) for text, links, _ in here) >= SMALL * worth:
            return " ".join(text for text, _, _ in here)
    return " ".join(text for text, _, _ in (held(best) if best else found))


def _votes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: dict[tuple[str, str], list] = {}
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            path, worth = best_container(*read(page or ""))
            if path:
                vote = total.setdefault((host, path), [0.0, 0])
                vote[0] += worth
                vote[1] += 1
        yield pa.RecordBatch.from_pydict(
            {
                "host": pa.array([h for h, _ in total], pa.string()),
                "path": pa.array([p for _, p in total], pa.string()),
                "score": pa.array([v[0] for v in total.values()], pa.float64()),
                "pages": pa.array([v[1] for v in total.values()], pa.int64()),
            }
        )


def _extract(schema_names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "", w) for p, w in zip(batch.column("html").to_pylist(), batch.column("winner").to_pylist(), strict=True)]
            columns = [batch.column(k) for k in schema_names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*schema_names, "main_text"])

    return run


#: Winning paths up to this many hosts are broadcast (some hundred bytes each); beyond, pages meet them in a salted join.
BROADCAST_HOSTS = 100_000
SALTS = 32


def extract_main_text(pages: DataFrame, space: Workspace, url: str = "url", html: str = "html", key: str = "page_id", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """One row per row of ``pages``: key, url, text, n_chars.

    Every container (article, main, section, div, td, body, blockquote) of a page has a path of tags and classes, numbers
    generalised. Each page votes for its outermost container that still adds unlinked text (``best_container``) with the
    worth of that text, links against it. Votes are summed over all pages of their host, and the best path of a host is
    the one from which all its pages are read again; a page where that path has little of the text is read from its own
    best container. Menus, page headers, footers, asides, forms, scripts, styles, adverts, notices
    and reader comments are left out by tag, role, class or id; a class or id decides only where the element is neither the
    page's article nor around it nor holds most of the page's text (``judge``); so is a form, which may hold a whole page. White space in a block becomes one space, blocks are
    joined by one space in page order; nothing is cut.

    Reading a page takes time and memory in proportion to its length, however deep its elements stand. A null html gives an
    empty text; a null or odd url counts as one host without a name. Rows are kept one to one,
    repeated ones included; extra columns are ignored; ties go to the path last in order. An empty table gives no rows.

    Plan: each task sums its votes by host and path before the shuffle, so a host with a third of all pages is a few
    rows a batch. Texts don't move unless there are more hosts than ``broadcast_hosts``.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1), F.lit("")))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    votes = rows.select("host", "html").mapInArrow(_votes, "host string, path string, score double, pages long")
    paths = votes.groupBy("host", "path").agg(F.sum("score").alias("score"), F.sum("pages").alias("pages"))
    best = F.max_by("path", F.struct(F.round("score", 3).alias("score"), F.col("path")))
    winners = space.write(paths.groupBy("host").agg(best.alias("winner")), "winners")
    if winners.count() <= broadcast_hosts:
        met = rows.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    fields = [rows.schema["key"], T.StructField("url", T.StringType()), T.StructField("main_text", T.StringType())]
    found = met.select("key", "url", "html", "winner").mapInArrow(_extract(["key", "url"]), T.StructType(fields))
    return found.select(F.col("key").alias(key), "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
