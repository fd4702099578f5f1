"""Main text of web pages by a site style tree.

The pages of one host are merged into one tree of styles (tag, class and id along the way from the body). A
presentation node is important if its pages lay it out in many ways; a content node if what it holds differs from
page to page, measured by the entropy of its blocks over the host's distinct pages; an inner node takes both, its content's
share from all leaves below it. What a host shows on few pages leans on the tree of all hosts. The branch that holds
most of a host's important text is its main branch, and what lies outside it loses importance by that branch's share.
Names are further evidence: a class or id that tells a purpose can be outvoted by the statistics, while an element or
role that states one, and comments and adverts, which differ from page to page by nature, weigh more. Branches of low
importance are removed from each page, unless something important lies in them.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialise
from quarry.llm.url_filter import host_and_path

#: The importance below which a branch goes, and the share of an inner node's importance that comes from its content.
THRESHOLD, CONTENT_SHARE = 0.5, 0.9
#: What is held of a node that no page shows, and the number of pages that this (or the tree of all hosts) weighs.
UNKNOWN, WEIGHT = 0.75, 8
#: The share of a host's important text beyond which a branch is its main branch; what its share takes from all outside.
MAIN, OUTSIDE = 0.6, 0.6
#: What a purpose that is stated (elements, roles, comments, adverts), named or hinted at takes, and an article gives.
STATED, NAMED, HINTED, ARTICLE = -0.6, -0.45, -0.3, 0.5
#: Levels of nesting with nodes of their own. A node below hangs under the deepest of them, by its own label and the
#: least of what the names on its way say.
DEPTH = 128

# Names of HTML elements and of common purposes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea select".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre "
    "section summary table tbody td tfoot th thead title tr ul caption".split()
)
_NOISE_TAGS = frozenset("nav footer aside form head title menu dialog button fieldset".split())
_NOISE_NAMES = frozenset(
    "banner promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription nav "
    "navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer header masthead share sharing social widget "
    "login signup search pagination pager toolbar skip copyright legal disclaimer".split()
)
#: Purposes whose text differs from page to page by nature, so that no entropy tells them.
_VARIED_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored comment comments disqus respond reply replies related recommended recommendations".split())
#: Of these, what states its purpose whatever else a name says.
_READERS = frozenset("comment comments disqus".split())
#: Words that say nothing of a purpose.
_NEUTRAL_NAMES = frozenset("a all area bar block bottom box button buttons container form inner item items left link links list main nav outer page right row section site thread top wrap wrapper".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_CONTENT_TAGS, _CONTENT_ROLES = frozenset(["article", "main"]), frozenset(["main", "article"])
#: Plain text containers: under an article they are its text, whatever their statistics.
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li ul ol dl dt dd table tbody thead tfoot tr td th figure figcaption caption".split())
#: What an opening tag closes without saying so.
_CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_SCOPE = frozenset("ul ol dl table body html article section div main".split())

# An attempt never runs beyond the next ``<`` outside quotes, so broken tags cost linear time.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|<[!?][^<>]*+>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME, _DIGITS = re.compile(r"[a-z]+"), re.compile(r"[0-9]+")


def _named(names: str) -> float:
    """What a class or an id says: a purpose if nothing in it says anything else, a hint if something does."""
    least = 0.0
    for name in names.split():
        words = _NAME.findall(name)
        known = [w for w in words if w in _NOISE_NAMES or w in _VARIED_NAMES]
        if known:
            whole = any(w in _READERS for w in known) or all(w in known or w in _NEUTRAL_NAMES for w in words)
            least = min(least, (STATED if any(w in _VARIED_NAMES for w in known) else NAMED) if whole else HINTED)
    return least


class Style:
    """What a tag with its attributes is: its label, and what its names say of it. ``hidden`` is no part of the label: it holds for one element only."""

    __slots__ = ("label", "evidence", "content", "plain", "hidden")

    def __init__(self, tag: str, attributes: str):
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "").strip().lower() for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
        names = " ".join(filter(None, (found.get("class"), found.get("id"))))
        role = found.get("role", "")
        # Numbers in names mostly count pages or places; with them every page would have styles of its own.
        self.label = f"{tag}.{' '.join(sorted(_DIGITS.sub('0', names).split()))}" if names else tag
        if role in _NOISE_ROLES or role in _CONTENT_ROLES:
            self.label = f"{self.label}@{role}"
        self.hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        self.evidence = STATED if tag in _NOISE_TAGS or role in _NOISE_ROLES else 0.0 if tag in ("body", "html") else _named(names)
        self.content = self.evidence == 0 and (tag in _CONTENT_TAGS or role in _CONTENT_ROLES)
        self.plain = tag in _PLAIN and not names


_STYLES: dict[tuple[str, str], Style] = {}


def _style(tag: str, attributes: str) -> Style:
    key = (tag, attributes)
    found = _STYLES.get(key)
    if found is None:
        if len(_STYLES) >= 20_000:
            _STYLES.clear()
        found = _STYLES[key] = Style(tag, attributes)
    return found


class Node:
    """An open element. ``chain``: the nodes of its style from the root; ``evidence``: what its names say of it, with what they say on the way."""

    __slots__ = ("tag", "chain", "evidence", "inside", "inline", "hidden")

    def __init__(self, tag: str, chain: tuple[int, ...], evidence: float, inside: bool, inline: bool, hidden: bool):
        self.tag, self.chain, self.evidence, self.inside, self.inline, self.hidden = tag, chain, evidence, inside, inline, hidden


class Block:
    __slots__ = ("text", "chain")

    def __init__(self, text: str, chain: tuple[int, ...]):
        self.text, self.chain = text, chain


#: Of a node on a page: the labels of its children, what its names say, whether it may hold a page's text, its depth.
Seen = tuple[dict[str, None], float, bool, int]


def parse(page: str) -> tuple[list[Block], dict[int, Seen]]:
    """Text blocks in page order without what is hidden, each with the nodes that it lies in, and all nodes of the page."""
    root = Node("", (), 0.0, False, False, False)
    stack, blocks, nodes, words = [root], [], {}, []
    at, n = 0, len(page)
    open_: dict[str, int] = {}

    def flush() -> None:
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                blocks.append(Block(text, stack[-1].chain))

    def close(count: int) -> None:
        while len(stack) > count:
            open_[stack.pop().tag] -= 1

    def opened(tag: str, attributes: str, inline: bool = False) -> None:
        top, style = stack[-1], _style(tag, attributes)
        evidence = STATED if tag == "header" and not top.inside else style.evidence
        noise = min(evidence, top.evidence, 0.0) if len(top.chain) >= DEPTH else evidence
        inside = style.content or top.inside and top.evidence >= 0
        if noise >= 0 and (style.content or style.plain and inside and top.evidence >= 0):
            noise = ARTICLE
        above = top.chain[: DEPTH - 1] if len(top.chain) >= DEPTH else top.chain
        node = _child(above[-1] if above else 0, style.label if len(top.chain) < DEPTH else f"{style.label} {noise} {inside}")
        hidden = top.hidden or style.hidden or inline and style.evidence == STATED
        if not hidden:
            if top.chain and top.chain[-1] in nodes:
                nodes[top.chain[-1]][0][style.label] = None
            nodes.setdefault(node, ({}, noise, not style.plain and not inline, len(above)))
        stack.append(Node(tag, (*above, node), noise, inside, inline, hidden))
        open_[tag] = open_.get(tag, 0) + 1

    for m in _TAG.finditer(page):
        start = m.start()
        if start < at:
            continue
        if start > at and not stack[-1].hidden and stack[-1].tag != "head" and stack[-1].tag != "title":
            part = page[at:start]
            words.append(unescape(part) if "&" in part else part)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if tag in _RAW:
            if not (m[1] or m[4]) and not (m[3] or m[6] or "").endswith("/"):
                end = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            words.append(" ")
        elif tag == "br":
            words.append(" ")
        elif tag in _BLOCK:
            flush()
            if m[1] or m[4]:
                for k in range(len(stack) - 1, 0, -1) if open_.get(tag) else ():
                    if stack[k].tag == tag:
                        close(k)
                        break
            elif tag not in _VOID:
                _imply(stack, tag, close)
                opened(tag, m[3] or m[6] or "")
        elif tag not in _VOID:
            if m[1] or m[4]:
                if stack[-1].inline and stack[-1].tag == tag:
                    close(len(stack) - 1)
            else:
                style = _style(tag, m[3] or m[6] or "")
                # Within a block, what no statistics could save goes at once.
                if style.evidence == STATED or style.hidden or stack[-1].inline and stack[-1].tag == tag:
                    opened(tag, m[3] or m[6] or "", inline=True)
    if at < n and not stack[-1].hidden:
        words.append(unescape(page[at:]) if "&" in page[at:] else page[at:])
    flush()
    return blocks, nodes


def _imply(stack: list[Node], tag: str, close) -> None:
    if stack[-1].tag == "head" and tag != "title" or stack[-1].tag == "title":
        close(next(k for k, x in enumerate(stack) if x.tag == "head") if any(x.tag == "head" for x in stack) else len(stack) - 1)
    while stack[-1].inline:
        close(len(stack) - 1)
    if stack[-1].tag == "p" or stack[-1].tag[:1] == "h" and stack[-1].tag[1:].isdigit():
        close(len(stack) - 1)
    ends = _CLOSES.get(tag)
    if ends:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in ends:
                close(k)
            elif stack[k].tag in _SCOPE:
                break


def _digest(text: str) -> int:
    from xxhash import xxh64_intdigest

    value = xxh64_intdigest(text)
    return value - (1 << 64) if value >> 63 else value


_CHILDREN: dict[tuple[int, str], int] = {}


def _child(above: int, label: str) -> int:
    """The node of a label below another node, as a hash of both."""
    key = (above, label)
    found = _CHILDREN.get(key)
    if found is None:
        if len(_CHILDREN) >= 100_000:
            _CHILDREN.clear()
        found = _CHILDREN[key] = _digest(f"{above}/{label}")
    return found


_SEEN = "host long, page long, held array<struct<node: long, feature: long, chars: long>>, nodes array<struct<node: long, layout: long, evidence: double, wraps: boolean, depth: int>>, above array<struct<leaf: long, up: long>>"
_HELD = pa.struct([("node", pa.int64()), ("feature", pa.int64()), ("chars", pa.int64())])
_NODES = pa.struct([("node", pa.int64()), ("layout", pa.int64()), ("evidence", pa.float64()), ("wraps", pa.bool_()), ("depth", pa.int32())])
_ABOVE = pa.struct([("leaf", pa.int64()), ("up", pa.int64())])


def _observe(batches):
    """Per page, what its leaf nodes hold, the layout of its nodes, and (once a task) which nodes stand above a leaf. No text."""
    known: set[int] = set()
    for b in batches:
        pages, held, layouts, above = [], [], [], []
        for page in b.column(1):
            blocks, nodes = parse(page.as_py() or "")
            seen = {(x.chain[-1] if x.chain else 0, _digest(x.text)): len(x.text) for x in blocks}
            held.append([(node, feature, chars) for (node, feature), chars in seen.items()])
            layouts.append([(node, _digest("|".join(labels)), evidence, wraps, depth) for node, (labels, evidence, wraps, depth) in nodes.items()])
            pages.append(_digest(repr((held[-1], layouts[-1]))))
            new = {x.chain for x in blocks if x.chain and x.chain[-1] not in known}
            known.update(chain[-1] for chain in new)
            above.append([(chain[-1], up) for chain in new for up in chain])
            if len(known) > 100_000:
                known.clear()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pages, pa.int64()), _structs(held, _HELD), _structs(layouts, _NODES), _structs(above, _ABOVE)], names=["host", "page", "held", "nodes", "above"])


def _structs(rows: list[list[tuple]], kind: pa.StructType) -> pa.ListArray:
    offsets = [0]
    for r in rows:
        offsets.append(offsets[-1] + len(r))
    columns = list(zip(*(x for r in rows for x in r), strict=True)) or [()] * kind.num_fields
    inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner, type=pa.list_(kind))


def _cut(batches):
    """Per page, its blocks but those of its host's low leaves, which are read once for many pages of a host."""
    known: dict[int, frozenset[int]] = {}
    for b in batches:
        texts = []
        for page, low, host in zip(b.column(2), b.column(3), b.column(4).to_pylist(), strict=True):
            gone = known.get(host)
            if gone is None:
                if len(known) >= 1000:
                    known.clear()
                gone = known[host] = frozenset(low.values.to_pylist()) if low.is_valid else frozenset()
            texts.append("\n\n".join(x.text for x in parse(page.as_py() or "")[0] if (x.chain[-1] if x.chain else 0) not in gone))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: one row per row of ``pages``.

    Blocks stand in page order, joined by a blank line; references are decoded, white space within a block is one
    space. Pages are parsed twice, for the tree and for their text, so that no text is written in between. Null and
    empty pages have an empty text. Null URLs share one empty host. Repeated rows stay; other columns aren't read; an
    empty table gives no rows.
    """
    host, _ = host_and_path(F.col(url_col).cast("string"))
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), F.xxhash64(host).alias("host"))
    # One row per host with its low leaves. Written, its size is known when the join is planned: under the broadcast
    # threshold the pages stay where they are; beyond it Spark shuffles both sides and splits hot hosts.
    low = low_leaves(source.select("host", "html"))
    by_host = materialise(low.groupBy("host").agg(F.collect_set("node").alias("low")), "low_by_host")
    discard(low)
    cut = source.join(by_host, "host", "left").select("page_id", "url", "html", "low", "host").mapInArrow(_cut, "page_id long, url string, text string")
    return cut.withColumn("n_chars", F.char_length("text").cast("long"))


def _spread(rows: DataFrame, keys: list[str], feature: str, *more) -> DataFrame:
    """``keys.., n, s``: what ``k`` counts under a key, and the sum of k ln k over its features' counts k."""
    counted = rows.groupBy(*keys, feature).agg(F.count("*").alias("k"), *more)
    return counted.groupBy(*keys).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.ln("k")).alias("s"), *more)


def _importance(seen: DataFrame, above: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """``by.., node, pages, importance`` and, written, ``by.., node, n, s, chars`` of leaves over the distinct pages of one host (``by`` = host) or of all."""
    keys = [*by, "node"]
    layout = seen.select(*by, F.explode("nodes").alias("x")).select(*by, "x.node", "x.layout")
    content = seen.select(*by, F.explode("held").alias("x")).select(*by, "x.node", "x.feature", "x.chars")
    shown = _spread(layout, keys, "layout").select(*keys, F.col("n").alias("pages"), F.when(F.col("n") > 1, (F.ln("n") - F.col("s") / F.col("n")) / F.ln("n")).otherwise(1.0).alias("layout"))
    held = materialise(_spread(content, keys, "feature", F.sum("chars").alias("chars")), "held")
    leaves = held.join(shown, keys).select(*keys, "chars", F.when(F.col("pages") > 1, 1 - F.col("s") / F.col("n") / F.ln("pages")).otherwise(1.0).alias("leaf"))
    through = leaves.withColumnRenamed("node", "leaf_node").join(above.withColumnRenamed("leaf", "leaf_node"), "leaf_node").select(*by, F.col("up").alias("node"), "chars", "leaf", (F.col("up") != F.col("leaf_node")).cast("int").alias("inner"))
    below = through.groupBy(*keys).agg((F.sum(F.col("chars") * F.col("leaf")) / F.sum("chars")).alias("content"), F.max("inner").alias("inner"))
    mixed = (1 - CONTENT_SHARE) * F.col("layout") + CONTENT_SHARE * F.col("content")
    return shown.join(below, keys).select(*keys, "pages", F.when(F.col("inner") == 1, mixed).otherwise(F.col("content")).alias("importance")), held


def _main(kept: DataFrame, above: DataFrame, names: DataFrame, *by: str) -> DataFrame:
    """``by.., up, share``: the main branch and its share of the important text, where there is one.

    ``kept``: ``by.., node, mass``, the important text of leaves that no low branch holds. A branch of over half of
    the mass has no like beside it, so those of over ``MAIN`` of it lie within each other, and the deepest that may
    hold a page's text is the main branch.
    """
    branch = kept.withColumnRenamed("node", "leaf").join(above, "leaf").groupBy(*by, F.col("up").alias("node")).agg(F.sum("mass").alias("mass"))
    branch = branch.join(names.where("wraps").select("node", "depth"), "node")
    if by:
        branch = branch.join(kept.groupBy(*by).agg(F.sum("mass").alias("total")), list(by))
    else:
        branch = branch.withColumn("total", F.lit(kept.agg(F.sum("mass").alias("total")).first()["total"]))
    wide = branch.withColumn("share", F.col("mass") / F.col("total")).where(F.col("share") > MAIN)
    return wide.groupBy(*by).agg(F.max(F.struct("depth", "node", "share")).alias("main")).where("main is not null").select(*by, F.col("main.node").alias("up"), F.col("main.share").alias("share"))


def _away(mains: DataFrame, above: DataFrame, leaves: DataFrame, name: str) -> DataFrame:
    """``host, node, name``: the share of the host's main branch (``mains``: ``host, up, share``) for leaves outside it."""
    inside = above.join(mains, "up").select("host", F.col("leaf").alias("node"))
    return leaves.join(inside, ["host", "node"], "left_anti").join(mains.select("host", F.col("share").alias(name)), "host").select("host", "node", name)


def _wrappers(mains: DataFrame, above: DataFrame, names: DataFrame) -> DataFrame:
    """``host, up``: the nodes on the way to a host's main branch (``mains``: ``host, up, share``), itself included."""
    depth = names.select(F.col("node").alias("up"), "depth")
    ends = mains.select("host", "up").join(depth.withColumnRenamed("depth", "low"), "up").join(above, "up").select("host", "low", "leaf")
    return ends.join(above, "leaf").join(depth, "up").where("depth <= low").select("host", "up").distinct()


def low_leaves(source: DataFrame) -> DataFrame:
    """``host, node`` from ``source(host, html)``: leaves that go.

    A leaf goes if its own importance is low, if it lies in a branch that is low with the purpose that it is named for,
    or if it is low for lying outside the main branch. A branch that is low by statistics alone takes nothing along that
    is important itself, and a name takes nothing from the way to the main branch unless it states a purpose.
    """
    read = materialise(source.mapInArrow(_observe, _SEEN), "observed")
    above = materialise(read.select(F.explode("above").alias("x")).select("x.leaf", "x.up").distinct(), "above")
    # Copies of a page are one page: else what they hold would look like a template.
    seen = materialise(read.select("host", "page", "held", "nodes").dropDuplicates(["host", "page"]), "distinct_pages")
    names = materialise(seen.select(F.explode("nodes").alias("x")).groupBy("x.node").agg(F.min("x.evidence").alias("evidence"), F.max("x.wraps").alias("wraps"), F.min("x.depth").alias("depth")), "names")
    everywhere = seen.dropDuplicates(["page"])
    own, own_held = _importance(seen, above, "host")
    all_, all_held = _importance(everywhere, above)
    all_ = materialise(all_.select("node", ((F.col("pages") * F.col("importance") + WEIGHT * UNKNOWN) / (F.col("pages") + WEIGHT)).alias("all")), "all_nodes")
    value = (F.col("pages") * F.col("importance") + WEIGHT * F.col("all")) / (F.col("pages") + WEIGHT)
    judged = materialise(own.join(all_, "node").join(names, "node").select("host", "node", "pages", value.alias("value"), (value + F.col("evidence")).alias("score"), "evidence"), "judged")
    low = judged.where(F.col("score") < THRESHOLD).select("host", F.col("node").alias("up"), "evidence")
    leaves = own_held.select("host", "node", "chars").join(judged, ["host", "node"]).select("host", "node", "chars", "pages", "value", "score")
    # A branch goes only with all that is below it: a leaf by its own score, an inner node's leaves by a purpose that it is named for.
    under = leaves.select("host", F.col("node").alias("leaf")).join(above, "leaf").join(low, ["host", "up"])
    under = materialise(under.where((F.col("up") == F.col("leaf")) | (F.col("evidence") < 0)).select("host", "up", F.col("leaf").alias("node"), "evidence"), "under")
    stated = under.where((F.col("up") == F.col("node")) | (F.col("evidence") <= STATED)).select("host", "node").distinct()
    open_ = leaves.join(stated, ["host", "node"], "left_anti").select("host", "node", (F.col("chars") * F.col("value")).alias("mass"))
    wrappers = _wrappers(_main(open_, above, names, "host"), above, names)
    called = under.where((F.col("up") != F.col("node")) & (F.col("evidence") > STATED)).join(wrappers, ["host", "up"], "left_anti").select("host", "node")
    gone = materialise(stated.union(called).distinct(), "low_branches")
    rest = materialise(leaves.join(gone, ["host", "node"], "left_anti"), "rest")
    places = rest.select("host", "node")
    by_host = _away(_main(rest.select("host", "node", (F.col("chars") * F.col("value")).alias("mass")), above, names, "host"), above, places, "away")
    # The main branch of all hosts, by what is left of each leaf on any of them, counts for those that have it.
    some = rest.select("node").distinct().join(all_held.select("node", "chars"), "node").join(all_, "node").select("node", (F.col("chars") * F.col("all")).alias("mass"))
    having = judged.join(_main(some, above, names), F.col("node") == F.col("up")).select("host", "up", "share")
    by_all = _away(having, above, places, "away_all")
    away = (F.col("pages") * F.coalesce("away", F.lit(0.0)) + WEIGHT * F.coalesce("away_all", F.lit(0.0))) / (F.col("pages") + WEIGHT)
    far = rest.join(by_host, ["host", "node"], "left").join(by_all, ["host", "node"], "left").where(F.col("score") - OUTSIDE * away < THRESHOLD).select("host", "node")
    out = materialise(gone.union(far), "low_leaves")
    discard(read, above, seen, names, own_held, all_held, all_, judged, under, gone, rest)
    return out
