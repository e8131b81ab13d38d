"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is a path of elements with
their tag, class and role, and it knows how many pages have it, how its children
are laid out (presentation) and what text stands in it (content).  The importance of
a node is the entropy of its layouts or texts over the pages, from 0 (all alike) to
1 (all different, or one page only); a branch has the mean importance of its nodes,
discounted by depth.  What only pages with one and the same main text share counts as
one page, so a host that repeats an article does not make it unimportant.

The tree decides about every block: it stays where the importance of its branch plus a
prior reaches ``LEAST_IMPORTANCE``.  The prior comes from the markup.  It is -1 for what
the markup calls menus, headers, footers, sidebars, notices, adverts, forms, reader
comments or hidden, as these differ from page to page too, and for blocks outside the
article (or main) element of a page that has one; in it, it is 1 for paragraphs,
headings, list items, cells and the like, and ``BODY_PRIOR`` for other elements, so that
boxes which all articles of a host repeat go; it is 0 on pages without such an element.

Names count by whole class or id tokens: all parts of a token must be words of noise
or of its place or kind ("sidebar-left", not "social-contract").  Ids in an article are
mostly anchors, so those of headings, sections and the like say nothing there.  What is
marked as noise is lifted where it wraps the main text: a main element, an article at
least as long as all other text, or, by name or as a form, over half of the page's text.
The tree then decides about it as about any other block.

A block is the text between two block-level tags; character references are decoded,
white space becomes one space.  A null html is an empty page, a null url has the
host "".  A page without main text gives an empty text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terranet.llm import words
from terranet.llm.tables import read
from terranet.plans.scratch import cut, is_empty

DEPTH_DISCOUNT = 0.9
LEAST_IMPORTANCE = 0.25
BODY_PRIOR = 0.2
_PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption blockquote pre figcaption summary".split())
_COMMENT_WORDS = frozenset("comment comments disqus replies respond responses reactions feedback discussion commentlist usercomments".split())
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle adbox adslot adunit adbanner banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toc "
    "header masthead topbar footer bottombar copyright colophon sidebar aside rail widget widgets "
    "cookie cookies consent gdpr notice notices alert popup popover modal overlay dialog toast paywall "
    "newsletter subscribe subscription signup login social share sharing related recommended trending search".split())
# Parts of names that say where a thing stands or what it is made of, and nothing else
_NEUTRAL_WORDS = frozenset(
    "site page main global top bottom left right center primary secondary sub mobile desktop sticky fixed inner outer wrapper wrap container content section area "
    "box block bar panel list item items group row col column grid link links button buttons btn icon icons image logo title heading label text body form input "
    "unit slot google post posts article articles entry entries story stories news recent latest popular count tools toolbar info user blog".split())
_ANCHOR_COMMENT_WORDS = frozenset("comment comments disqus commentlist usercomments".split())
_NOISE_TAGS = frozenset("nav footer aside form menu dialog button select datalist label fieldset".split())
_RAW_TAGS = frozenset("script style noscript template iframe svg math canvas object audio video map title textarea xmp noembed noframes".split())
_VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK_TAGS = frozenset(
    "html body head article section main header h1 h2 h3 h4 h5 h6 p div ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre address figure figcaption hr details summary center hgroup".split()) | _NOISE_TAGS
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
_TAG = re.compile(
    r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|[!?][^>]*>|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*>|"
    r"(?P<start>[a-zA-Z][^\s/>]*)(?P<rest>[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>|(?P<odd>[a-zA-Z][^\s/>]*)[^>]*>)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z_:][-\w:.]*)")
_WORD = re.compile(r"[a-z]+")
_ABOUT_OTHERS = re.compile(r"\b(?:has|with|no|without)[-_][\w-]+")  # "with-sidebar" names no sidebar
_CUT_OFF = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")  # a tag cut off at the end is no text
_KEYS: dict[tuple[int, str, str], int] = {}


@dataclass(slots=True, eq=False)
class _Mark:
    """An element that its markup calls noise."""
    kind: str               # hidden, tag, form, name or comment
    above: _Mark | None     # the next such element around it
    plain: int = 0          # characters outside links, those of other marks below left out
    lifted: bool = False


@dataclass(slots=True, eq=False)
class _Body:
    """An article or main element, or one named like an article's body."""
    kind: str               # article, main or hint
    above: _Body | None
    mark: _Mark | None
    plain: int = 0


@dataclass(slots=True)
class _Element:
    tag: str
    key: int
    mark: _Mark | None
    body: _Body | None
    main: bool      # in an article or main element
    hint: bool      # in an element named like an article's body
    link: bool
    block: str      # tag of the block-level element that it is or is in


@dataclass(slots=True)
class Block:
    text: str
    node: int
    tag: str
    noise: bool
    main: bool
    hint: bool
    linked: int     # characters inside links
    mark: _Mark | None = None
    body: _Body | None = None


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    layouts: dict[int, tuple[int, list[int]]] = field(default_factory=dict)  # node: its parent (0: none) and the keys of its children


def _key(parent: int, tag: str, style: str) -> int:
    at = (parent, tag, style)
    if at not in _KEYS:
        if len(_KEYS) > 200_000:
            _KEYS.clear()
        _KEYS[at] = xxhash.xxh64_intdigest(f"{parent} {tag} {style}") - (1 << 63)
    return _KEYS[at]


def _attributes(rest: str) -> dict[str, str]:
    if not rest or rest.isspace():
        return {}
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}


def _named(token: str, tag: str, inside: bool, anchor: bool) -> str | None:
    """Kind of noise that a class or, if ``anchor``, an id in an article means."""
    parts = {*_WORD.findall(token)}
    named = parts & (_NOISE_WORDS | _COMMENT_WORDS)
    if not named or any(len(x) > 1 for x in parts - named - _NEUTRAL_WORDS):
        return None
    comment = named & _COMMENT_WORDS
    if anchor:
        if tag not in ("div", "section", "ul", "ol") or tag == "section" and not named & _ANCHOR_COMMENT_WORDS:
            return None
        if comment and not comment & _ANCHOR_COMMENT_WORDS:
            return None
    if comment:
        return "comment"
    # article-header, post-title and the like belong to the article they stand in
    return None if inside and named <= {"header", "banner"} else "name"


def _open(tag: str, rest: str, above: _Element | None) -> _Element:
    own = _attributes(rest)
    role = own.get("role", "").lower()
    classes, name_id = own.get("class", "").lower(), own.get("id", "").lower()
    inside = above is not None and above.main
    article = tag in ("article", "main") or role in ("article", "main")
    kind = None
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in own.get("style", "").replace(" ", "").lower():
        kind = "hidden"
    elif tag in ("form", "fieldset") or role == "form":
        kind = "form"
    elif tag in _NOISE_TAGS or role in _NOISE_ROLES or tag == "header" and not inside:
        kind = "tag"
    elif classes or name_id:
        kinds = {_named(x, tag, inside, False) for x in _ABOUT_OTHERS.sub("", classes).split()}
        # old page generators write sections as div elements
        anchor = inside and not article
        if not (anchor and tag == "div" and "section" in classes.split()):
            kinds |= {_named(x, tag, inside, anchor) for x in _ABOUT_OTHERS.sub("", name_id).split()}
        kind = "comment" if "comment" in kinds else "name" if "name" in kinds and not (article or tag in ("html", "body")) else None
    mark, body = (above.mark, above.body) if above is not None else (None, None)
    if kind is not None:
        mark = _Mark(kind, mark)
    hinted = own.get("itemprop", "").lower() == "articlebody" or bool(
        re.search(r"\b(article|post|entry|story)[-_]?(body|content|text)\b", _ABOUT_OTHERS.sub("", f"{classes} {name_id}")))
    hint = above is not None and above.hint or hinted
    if article and kind is None:
        body = _Body("main" if "main" in (tag, role) else "article", body, mark)
    elif hinted and kind is None and body is None:
        body = _Body("hint", body, mark)
    style = f"{' '.join(sorted(own.get('class', '').split()))} {role}"
    return _Element(tag, _key(above.key if above else 0, tag, style), mark, body, inside or article, hint,
                    tag == "a" or above is not None and above.link, tag if tag in _BLOCK_TAGS else above.block)


def _live(mark: _Mark | None) -> list[_Mark]:
    found = []
    while mark is not None:
        if not mark.lifted:
            found.append(mark)
        mark = mark.above
    return found


def _lift(page: Page, marks: list[_Mark], bodies: list[_Body]) -> None:
    """Take back the marks of elements that wrap the main text, and set the noise of all blocks."""
    of_mark: dict[_Mark, int] = {m: m.plain for m in marks}
    soft = {"name", "form"}
    for m in reversed(marks):  # children come after what is around them
        if m.above is not None and m.kind in soft and m.above.kind in soft:
            of_mark[m.above] += of_mark[m]
    plain = [len(b.text) - min(b.linked, len(b.text)) for b in page.blocks]
    state: dict[_Mark | None, bool] = {}

    def settle() -> None:
        state[None] = False
        for m in marks:
            state[m] = not m.lifted or state[m.above]

    settle()
    whole = sum(n for b, n in zip(page.blocks, plain) if b.mark is None) + sum(m.plain for m in marks if m.kind in soft)
    for m in marks:
        if m.kind in soft and 2 * of_mark[m] > whole:
            m.lifted = True
    for body in bodies:
        if body.kind == "main":
            live = _live(body.mark)
            if all(m.kind in ("name", "form", "tag") for m in live):
                for m in live:
                    m.lifted = True
    settle()
    for b in reversed(bodies):
        if b.above is not None:
            b.above.plain += b.plain
    kinds = {"article"} if any(b.kind == "article" for b in bodies) else {"hint"} if all(b.kind == "hint" for b in bodies) else set()
    # an article in another one is a part of it
    candidates = [b for b in bodies if b.kind in kinds and (b.above is None or b.above.kind == "main")]
    rivals: dict[_Body | None, tuple[bool, int]] = {}
    for b in sorted(candidates, key=lambda b: -b.plain):
        live = _live(b.mark)
        if not live or any(m.kind == "hidden" for m in live):
            continue
        if b.above not in rivals:
            free = [x.plain for x in candidates if x.above is b.above and not state[x.mark]]
            rivals[b.above] = bool(free), max(free) if free else sum(
                n for x, n in zip(page.blocks, plain) if not state[x.mark] and (b.above is None or x.body is b.above))
        free, rival = rivals[b.above]
        allowed = soft if free else soft | {"tag"} if rival else soft | {"tag", "comment"}
        if b.plain >= rival and all(m.kind in allowed for m in live):
            for m in live:
                m.lifted = True
            settle()
            rivals.clear()
    for block in page.blocks:
        block.noise = state[block.mark]


def parse(source: str) -> Page:
    """Blocks of a page in order, and the layout of its elements.  Bad markup is read as browsers do, in short."""
    page, stack = Page(), [_open("html", "", None)]
    page.layouts[stack[0].key] = (0, [])
    text: list[str] = []
    marks: list[_Mark] = []
    bodies: list[_Body] = []
    linked, at = 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                top = stack[-1]
                page.blocks.append(Block(whole, top.key, top.block, top.mark is not None, top.main, top.hint, linked, top.mark, top.body))
                for holder in (top.mark, top.body):
                    if holder is not None:
                        holder.plain += max(len(whole) - linked, 0)
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            plain = entities.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if stack[-1].link:
                linked += len(plain)

    def close(tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    while (found := _TAG.search(source, at)) is not None:
        add(source[at:found.start()])
        at = found.end()
        if (tag := found["end"]) is not None:
            tag = tag.lower()
            if tag in _BLOCK_TAGS:
                flush()
            if tag not in ("html", "body"):
                close({tag}, {"article", "main"} - {tag} if tag not in _BLOCK_TAGS or tag == "p" else frozenset())
        elif (tag := found["start"] or found["odd"]) is not None:
            tag = tag.lower()
            if tag in _RAW_TAGS:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if tag in ("html", "head"):
                flush()
                continue
            if tag == "br":
                text.append("\n")
                continue
            if tag in _BLOCK_TAGS:
                flush()
                close({"p"}, {"article", "section", "div", "td", "th", "li", "main", "blockquote"})
                if tag in _ENDS:
                    close(_ENDS[tag], _SCOPES[tag])
            if tag in _VOID_TAGS or (found["rest"] or "").endswith("/") and tag not in _BLOCK_TAGS:
                continue
            element = _open(tag, found["rest"] or "", stack[-1])
            if element.mark is not stack[-1].mark:
                marks.append(element.mark)
            if element.body is not stack[-1].body:
                bodies.append(element.body)
            if tag in _BLOCK_TAGS:
                above = stack[-1].key  # an inline element has that of the block it is in
                page.layouts[above][1].append(element.key)
                page.layouts.setdefault(element.key, (above, []))
                if tag == "body" and any(e.tag == "body" for e in stack):
                    continue
            else:
                element.key = stack[-1].key  # inline elements have no node of their own
            stack.append(element)
    add(_CUT_OFF.sub("", source[at:]))
    flush()
    if marks:
        _lift(page, marks, bodies)
    return page


def body_blocks(page: Page) -> list[Block] | None:
    """Blocks of the article or main element, or else of one named like an article's body; None if there is none."""
    clean = [b for b in page.blocks if not b.noise]
    return [b for b in clean if b.main] or [b for b in clean if b.hint] or None


def main_text(page: Page, low: frozenset[int] | set[int] = frozenset(), lowest: frozenset[int] | set[int] = frozenset()) -> str:
    """Main text of a page.

    ``low`` are the nodes of its site with less than the least importance, ``lowest`` those that stay below it in an article.
    """
    body = body_blocks(page)
    if body is None:
        return "\n\n".join(b.text for b in page.blocks if not b.noise and b.node not in low)
    return "\n\n".join(b.text for b in body if b.tag in _PROSE_TAGS or b.node not in lowest)


def _hash(value: object) -> int:
    return xxhash.xxh64_intdigest(repr(value)) - (1 << 63)


_NODES = "host long, node long, parent long, kind boolean, value long, about long"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per page and node: the hash of its layout (kind false) or of its text (kind true), and of the page's main text."""
    for batch in batches:
        for i, j in words.slices(batch.column(1), 8 << 20):
            rows: list[tuple] = []
            for host, source in zip(batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist()):
                page = parse(source)
                texts: dict[int, list[str]] = {}
                for block in page.blocks:
                    texts.setdefault(block.node, []).append(block.text)
                about = _hash([b.text for b in body_blocks(page) or page.blocks])
                for node, (parent, children) in page.layouts.items():
                    if children:
                        runs = [c for k, c in enumerate(children) if not k or children[k - 1] != c]  # a run of like children counts once
                        rows.append((host, node, parent, False, _hash(runs), about))
                    if node in texts:
                        rows.append((host, node, parent, True, _hash(texts[node]), about))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["host", "node", "parent", "kind", "value", "about"])


def _host(url: Column) -> Column:
    return F.xxhash64(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))


def style_tree(pages: DataFrame, discount: float = DEPTH_DISCOUNT) -> DataFrame:
    """Nodes of all site trees: host, node, pages, importance (of the branch below the node).

    Counts of equal layouts and texts are summed before they are shuffled, so a host
    with a third of all pages is no problem.
    """
    rows = pages.select(_host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(_nodes, _NODES)
    seen = rows.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("c"), F.min("about").alias("one"), F.max("about").alias("other"), F.min("parent").alias("parent"))
    seen = seen.withColumn("c", F.when(F.col("one") == F.col("other"), 1).otherwise(F.col("c")))
    kinds = seen.groupBy("host", "node", "kind").agg(F.sum("c").alias("pages"), F.sum(F.col("c") * F.log("c")).alias("s"), F.min("parent").alias("parent"))
    own = F.when(F.col("pages") > 1, 1 - F.col("s") / (F.col("pages") * F.log("pages"))).otherwise(1.0)
    # a leaf counts in full, an inner node by what the discount leaves for the layout
    weight = F.col("pages") * F.when(F.col("kind"), 1.0).otherwise(1 - discount)
    nodes = kinds.groupBy("host", "node").agg(F.max("pages").alias("pages"), F.sum(weight).alias("weight"), F.sum(weight * own).alias("whole"), F.min("parent").alias("above"))
    branches = _branch_sums(cut(nodes, "site-nodes"), discount)
    return branches.select("host", "node", "pages", (F.col("whole") / F.col("weight")).alias("importance"))


def _branch_sums(nodes: DataFrame, discount: float) -> DataFrame:
    """``weight`` and ``whole`` of every node summed over its branch, discounted by depth.

    A round adds the sums of the nodes 2^k levels below, so rounds are logarithmic in the depth.
    """
    step = 1
    while True:
        below = nodes.filter("above <> 0").groupBy("host", F.col("above").alias("node")).agg(F.sum("weight").alias("w"), F.sum("whole").alias("v"))
        above = nodes.select("host", F.col("node").alias("above"), F.col("above").alias("further"))
        share = float(discount ** step)
        more = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0.0)) * share).alias(x)
        nodes = cut(nodes.join(below, ["host", "node"], "left").join(above, ["host", "above"], "left").select(
            "host", "node", "pages", more("weight", "w"), more("whole", "v"), F.coalesce("further", F.lit(0).cast("long")).alias("above")), "site-nodes")
        if is_empty(nodes.filter("above <> 0")):
            return nodes
        step *= 2


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in words.slices(batch.column(2), 8 << 20):
            part = batch.slice(i, j - i)
            low, lowest = part.column(3).to_pylist(), part.column(4).to_pylist()
            texts = [main_text(parse(source), set(x or ()), set(y or ())) for source, x, y in zip(part.column(2).to_pylist(), low, lowest)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])


def extracted_pages(pages: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """page_id, url, text, n_chars of every row.  Other columns are ignored."""
    tree = style_tree(pages).filter((F.col("importance") < least) & (F.col("pages") > 1))
    beyond = F.when(F.col("importance") < least - BODY_PRIOR, F.col("node"))
    low = cut(tree.groupBy("host").agg(F.collect_list("node").alias("low"), F.collect_list(beyond).alias("lowest")), "site-noise")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce("html", F.lit("")).alias("html"), _host(F.col("url")).alias("host"))
    return rows.join(low, "host", "left").select("page_id", "url", "html", "low", "lowest").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted_pages(read(spark, sf_dir, "pages"))
