from __future__ import annotations

import html
import re

from quarry.llm import html_extract as h
from quarry.llm.queries import op9_html_extraction


def article_text(page):
    inner = re.search(r"(?s)<article>(.*?)(</article>|<footer|\Z)", page)[1]
    inner = re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", re.sub(r"<(h1|p|/p|/h1)>", "\x00", inner)))
    return "\n\n".join(x for x in (" ".join(html.unescape(y).split()) for y in inner.split("\x00")) if x)


def test_query(spark, data):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = op9_html_extraction(spark, data).collect()
    assert len(rows) == len(pages)
    assert all(r["text"] == article_text(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"] for r in rows)


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in h.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_names_tell_boilerplate(spark):
    page = (
        "<html><head><title>T</title></head><body><header class=site><h1>Site</h1></header><div id='cookie-notice'>We use cookies</div><nav><ul><li>Home</ul></nav><main><article><header><h1>Title &amp; more</h1></header>"
        "<p>One <b>bold<br>line</b> &lt;x&gt;&#39;s<p>Two<div class='share'>Share this</div><ul><li>a<li>b</ul><aside>See also</aside><form><input>Send</form><section id=comments><p>First!</section></article></main>"
        "<div class=\"ad banner\">Buy</div><footer>&copy; me</footer><script>if (a<b) {'</p>'}</script><style>p{}</style></body></html>"
    )
    assert texts(spark, [(1, "http://a.com/", page)])[1] == "Title & more\n\nOne bold line <x>'s\n\nTwo\n\na\n\nb"


def test_statistics_tell_boilerplate(spark):
    """Blocks without telling names: what repeats on a host goes, what differs stays."""
    page = lambda k: f"<body><div class=a1><p>Same words everywhere</p></div><div class=b2><p>Story {k} of many</p><p>It goes on {k * 7}</p></div></body>"
    got = texts(spark, [(k, f"http://one.com/{k}", page(k)) for k in range(12)] + [(90, "http://two.com/", page(90))])
    assert all(got[k] == f"Story {k} of many\n\nIt goes on {k * 7}" for k in [*range(12), 90])


def test_hidden_elements_go_on_their_own_page_only(spark):
    page = lambda k, last: f"<body><div class=top>Top</div><article><p>Story {k}</p><p>More {k * 7}<span hidden>no <span>never</span> no</span></p>{last}</article></body>"
    lasts = ["<p hidden>Secret</p>", "<p aria-hidden=true>Secret</p>", "<p style='display: none'>Secret</p>", "<div role=search>Find</div>", "<div hidden><p>Secret</div>"]
    lasts += [f"<div>Box {k}</div><p>End {k}</p>" for k in range(7)]
    got = texts(spark, [(k, f"http://one.com/{k}", page(k, x)) for k, x in enumerate(lasts)])
    for k in range(12):
        assert got[k] == f"Story {k}\n\nMore {k * 7}" + (f"\n\nBox {k - 5}\n\nEnd {k - 5}" if k > 4 else "")


def test_copies_of_a_page_are_one_page(spark):
    """Neither equal rows of a page, on one host or on many, nor copies among other pages make a text a template."""
    page = lambda k: f"<body><div class=bar><p>Same words everywhere</p></div><div class=body><p>Story {k}</p><p>More {k * 7}</p></div></body>"
    alone = "<body><div class=only><p>One text</p><p>and its end</p></div></body>"
    rows = [(k, "http://four.com/x", alone) for k in range(4)] + [(10 + k, f"http://many{k}.com/x", alone.replace("only", "each")) for k in range(6)]
    rows += [(100 + k, f"http://hot.com/{k}", page(k if k < 20 else 20)) for k in range(60)]
    got = texts(spark, rows)
    assert {got[k] for k in [*range(4), *range(10, 16)]} == {"One text\n\nand its end"}
    assert all(got[100 + k] == f"Story {min(k, 20)}\n\nMore {min(k, 20) * 7}" for k in range(60))


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://a", ""), (3, "x", "plain text only"), (4, "http://a", "<p>unclosed <b>bold"), (4, "http://a", "<p>unclosed <b>bold"), (None, "http://a", "<<>< p><p>a</p"), (5, "http://b", "<p>" * 3000 + "deep"), (6, "http://b", "<script>never closed")]
    out = h.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = out.collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == "" and by[2] == "" and by[3] == "plain text only" and by[4] == "unclosed bold" and by[5] == "deep" and by[6] == ""
    assert h.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_pages_take_linear_time():
    for page in ("<a " * 100_000, "<p class='" * 50_000, "&" * 200_000, "<div>" * 20_000, "<!--" * 50_000, "< " * 100_000, "<!" * 100_000, "<div>" * 20_000 + "</p>" * 20_000):
        h.parse(page)


def test_names_are_evidence_and_statistics_can_outvote_them(spark):
    page = lambda k: (
        f"<body><div class=qa>Same line</div><article><h1 class='post-header'>Title {k}</h1><p>Story {k}</p><div class='social-history'><p>Past {k * 3}</p></div><div class='share-box'>Share {k * 5}</div><div class=zz>Rated by all</div>"
        f"<aside>Aside {k}</aside><div class=comments>Reader {k}</div><ul id='reader-comments'><li>Another {k}</ul><p>E = <math><mi>m</mi></math> <object>fallback {k}</object><span class=ad>Buy {k}</span></p></article><div class=qb>Teaser {k}</div></body>"
    )
    got = texts(spark, [(k, f"http://one.com/{k}", page(k)) for k in range(400)])
    assert all(got[k] == f"Title {k}\n\nStory {k}\n\nPast {k * 3}\n\nShare {k * 5}\n\nE = m fallback {k}" for k in range(400))


def test_the_tree_alone_finds_the_articles(spark, data):
    """Without any telling names, the statistics leave the same text."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{data}/pages.parquet")
    truth = {r["page_id"]: article_text(r["html"]) for r in pages.collect()}
    bare = F.col("html")
    for name, other in (("nav", "qa"), ("article", "qc"), ("footer", "qd")):
        bare = F.replace(F.replace(bare, F.lit(f"<{name}>"), F.lit(f"<div class={other}>")), F.lit(f"</{name}>"), F.lit("</div>"))
    bare = F.replace(bare, F.lit('class="ad"'), F.lit("class=qb"))
    assert {r["page_id"]: r["text"] for r in h.extract_main_text(pages.withColumn("html", bare)).collect()} == truth


def test_names_count_at_any_depth(spark):
    deep = lambda inner, n: "".join(f"<div class=x{chr(97 + k % 26)}{chr(97 + k // 26)}>" for k in range(n)) + inner
    rows = [(n, f"http://d{n}.com/", deep("<p>Text</p><aside><div><p>Notice</p></div></aside><p>More</p>", n)) for n in (3, 72, 127, 128, 129, 200, 400)]
    assert set(texts(spark, rows).values()) == {"Text\n\nMore"}


def plain_tree(rows):
    """The style tree in plain Python: ``host, leaf`` of all leaves that go."""
    from collections import Counter, defaultdict
    from math import log

    pages, names, above = {}, {}, defaultdict(set)
    for host, page in rows:
        blocks, nodes = h.parse(page)
        held = frozenset((b.chain[-1], b.text) for b in blocks)
        for b in blocks:
            above[b.chain[-1]] |= set(b.chain)
        shape = tuple((n, "|".join(x[0])) for n, x in nodes.items())
        pages[host, tuple((b.chain[-1], b.text) for b in blocks), shape] = (held, dict(shape))
        for n, x in nodes.items():
            names[n] = x[1:]

    def importance(some):
        shown, layouts, counts = Counter(), defaultdict(Counter), defaultdict(Counter)
        for held, shape in some:
            for n, layout in shape.items():
                shown[n] += 1
                layouts[n][layout] += 1
            for n, text in held:
                counts[n][text] += 1
        leaf = {n: (sum(c.values()), 1.0 if shown[n] < 2 else 1 - sum(k * log(k) for k in c.values()) / sum(c.values()) / log(shown[n])) for n, c in counts.items()}
        out, chars = {}, {n: sum(len(t) * k for t, k in c.items()) for n, c in counts.items()}
        for n in shown:
            under = [(m, x) for m, x in leaf.items() if n in above[m]]
            if under:
                content = sum(chars[m] * x[1] for m, x in under) / sum(chars[m] for m, _ in under)
                spread = 1.0 if shown[n] < 2 else (log(shown[n]) - sum(k * log(k) for k in layouts[n].values()) / shown[n]) / log(shown[n])
                out[n] = (shown[n], content if all(m == n for m, _ in under) else (1 - h.CONTENT_SHARE) * spread + h.CONTENT_SHARE * content)
        return out, chars

    def main(mass):
        total, branch = sum(mass.values()), Counter()
        for n, x in mass.items():
            for up in above[n]:
                branch[up] += x
        wide = [(names[n][2], n, x / total) for n, x in branch.items() if names[n][1] and x > h.MAIN * total]
        return max(wide, default=None)

    all_, all_chars = importance({(x[0], tuple(sorted(x[1].items()))): x for x in pages.values()}.values())
    all_ = {n: (k * x + h.WEIGHT * h.UNKNOWN) / (k + h.WEIGHT) for n, (k, x) in all_.items()}
    gone, rest, scores = set(), {}, {}
    for host in {x[0] for x in pages}:
        own, chars = importance([x for key, x in pages.items() if key[0] == host])
        value = {n: (k * x + h.WEIGHT * all_[n]) / (k + h.WEIGHT) for n, (k, x) in own.items()}
        low = {n for n, x in value.items() if x + names[n][0] < h.THRESHOLD}
        stated = {n for n in chars if n in low or any(names[u][0] <= h.STATED for u in above[n] & low)}
        first = main({n: x * value[n] for n, x in chars.items() if n not in stated})
        way = {u for n in chars if first and first[1] in above[n] for u in above[n] if names[u][2] <= first[0]}
        off = stated | {n for n in chars if any(h.STATED < names[u][0] < 0 for u in (above[n] & low) - way - {n})}
        gone |= {(host, n) for n in off}
        rest[host] = {n: x * value[n] for n, x in chars.items() if n not in off}
        scores[host] = (own, value)
    best = main({n: all_chars[n] * all_[n] for n in {n for x in rest.values() for n in x}})
    for host, mass in rest.items():
        own, value = scores[host]
        near = main(mass)
        for n in mass:
            away = near[2] if near and near[1] not in above[n] else 0.0
            away_all = best[2] if best and best[1] in own and best[1] not in above[n] else 0.0
            k = own[n][0]
            if value[n] + names[n][0] - h.OUTSIDE * (k * away + h.WEIGHT * away_all) / (k + h.WEIGHT) < h.THRESHOLD:
                gone.add((host, n))
    return gone


def test_low_leaves_are_those_of_a_plain_tree(spark):
    import random

    rng = random.Random(3)
    rows, tags = [], ["div", "div class=qa", "div class=qb", "section", "p", "p", "div class=share", "ul", "aside", "article"]

    def branch(depth):
        tag = rng.choice(tags)
        inner = rng.choice(["Same words", "Other words", f"Varied {rng.random()}", f"Words {rng.randrange(4)}"])
        return f"<{tag}>{inner}{''.join(branch(depth - 1) for _ in range(rng.randrange(3))) if depth else ''}</{tag.split()[0]}>"

    for k in range(160):
        rows.append((rng.choice([1, 1, 1, 2, 2, 3, 4, 5]), f"<body>{''.join(branch(3) for _ in range(rng.randrange(1, 4)))}</body>"))
    rows += rows[:30]
    got = {(r["host"], r["node"]) for r in h.low_leaves(spark.createDataFrame(rows, "host long, html string")).collect()}
    assert got == plain_tree(rows) and len(got) > 20


def test_an_article_stays_whatever_its_menu_is(spark):
    """Hosts of one layout each: nothing of an article goes, nothing else stays. What was put in is what is asked for."""
    import itertools
    import random

    rng = random.Random(1)
    said = lambda n: " ".join(rng.choice("alpha beta gamma delta river stone cloud market engine window paper".split()) for _ in range(n)) + f" {rng.randrange(10**6)}"
    rows, want = [], {}
    layouts = itertools.product((0, 3, 6, 10, 20, 50), (1, 4, 12, 30), ("<article>{}</article>", "<main>{}</main>", "<section>{}</section>", "<div class='page-header-layout'><div class='text'>{}</div></div>", "{}"), (True, False))
    for host, (items, paragraphs, frame, named) in enumerate(layouts):
        menu, foot = "".join(f"<li>{said(2)}</li>" for _ in range(items)), said(6)
        for page in range(15):
            blocks = [said(4)] + [said(rng.randrange(8, 40)) for _ in range(paragraphs)]
            body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
            top, end = (f'<nav class="nav"><ul>{menu}</ul></nav>', f'<div class="footer">{foot}</div>') if named else (f"<div><ul>{menu}</ul></div>", f"<div><span>{foot}</span></div>")
            want[len(rows)] = "\n\n".join(blocks)
            rows.append((len(rows), f"http://h{host}.example/{page}", f'<html><body><div class="page">{top}{frame.format(body)}{end}</div></body></html>'))
    got = texts(spark, rows)
    assert [rows[n][2][:300] for n in want if got[n] != want[n]] == []


def test_clashing_columns(spark, none):
    page = "<body><article><p>Text</p></article></body>"
    from pyspark.sql import functions as F

    odd = spark.createDataFrame([(1, "http://a.com/", page)], "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "page", "low", "node", "text", "held", "nodes", "leaf")})
    assert [r["text"] for r in h.extract_main_text(odd).collect()] == ["Text"]
