import random
import re

import pytest
from pyspark.sql import functions as F

from wardflow.llm import html_extract as hx

ARTICLE = "<h1>Title &amp; more</h1><p>First <b>bold</b> para.<p>Second&nbsp;&eacute;\n  line<br>break</p>"
TEXT = "Title & more\nFirst bold para.\nSecond é line break"


def page(body, extra=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body>{body}{extra}</body></html>"


@pytest.mark.parametrize("around", [
    '<nav><ul><li><a href="/x">Home</a></li></ul></nav>', '<div class="ad">Buy now, it is a long advert text here</div>',
    '<header><p>Site name</p></header>', '<footer>&copy; 2020</footer>', '<aside><p>See also this other story</p></aside>',
    '<form><p>Name</p><input name="a"><textarea>x</textarea></form>', '<div id="cookie-notice"><p>We use cookies</p></div>',
    '<div class="col sidebar-2"><p>Side text</p></div>', '<section class="comments"><p>I disagree with all of it.</p></section>',
    '<!-- <article><p>hidden</p></article> -->', '<noscript><p>Turn it on</p></noscript>', '<div class="newsletter signup">Join</div>',
])
def test_boilerplate_is_left_out(around):
    for html in (page(around + f"<article>{ARTICLE}</article>"), page(f"<article>{ARTICLE}</article>" + around),
                 page(f"{around}<div class='post-12 entry'>{ARTICLE}</div>{around}")):
        p = hx.Page(html)
        votes = p.votes()
        assert p.text(max(votes, key=lambda x: (votes[x], x))) == TEXT


def test_comments_inside_the_article():
    html = page(f'<article>{ARTICLE}<div class="comment-list"><p>Nice!</p></div></article>')
    assert hx.Page(html).text("body>article") == TEXT


@pytest.mark.parametrize("html", ["", "plain", "<p", "<p>x<", "<a title='x>y", "</div></p>", "<script>x", "<!-- x", "&#0;&bogus;&amp",
                                  "<p>" * 2000 + "deep" + "</p>" * 10, "<div>" * 3000 + "x", "< p>a < b</p>", "<p>a<p/>b"])
def test_odd_markup_does_not_fail(html):
    hx.Page(html).text(None)
    hx.Page(html).text("body>div")


def test_text_outside_tags_and_cut_tags():
    assert hx.Page("a &lt; b\n c<foo").text(None) == "a < b c"
    assert hx.Page("<p>one</p>two<div>three").text(None) == "one\ntwo\nthree"


def test_consensus_path_and_rows(spark):
    inner = "<div class='story-{}'><p>{}</p></div>"
    rows = [(i, f"http://a.example/{i}", page("<div class='top'><p>menu like words</p></div>" + inner.format(i, "long text " * 20)))
            for i in range(6)]
    odd = page("<div class='top'><p>" + "a long notice on this page only " * 20 + "</p></div>" + inner.format(9, "short text"))
    rows += [(9, "http://A.example/9", odd), (10, None, None), (11, "http://b.example/", ""), (12, "nohost", page("<p>x</p>")),
             (0, "http://a.example/0", rows[0][2]), (None, "http://c.example/", page(f"<main>{ARTICLE}</main>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as path", "'y' as host")
    out = hx.extract_text(df).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert by[9].text == "short text" and by[9].path == "body>div.story-#"
    assert by[1].text == ("long text " * 20).strip() and by[1].n_chars == len(by[1].text)
    assert by[10].text == by[11].text == "" and by[10].n_chars == 0
    assert by[12].text == "x" and by[None].text == TEXT
    assert hx.extract_text(df.limit(0)).count() == 0


LONG = "<p>" + "Body of the story. " * 30 + "</p>"
BODY = ("Body of the story. " * 30).strip()


@pytest.mark.parametrize("inner,want", [
    (f"<div class='title'><h1>Head</h1></div><div class='entry'>{LONG}</div>", f"Head\n{BODY}"),
    (f"<h1>Head</h1><div class='lead'><p>A lead of some words here.</p></div><div class='entry'>{LONG}</div>",
     f"Head\nA lead of some words here.\n{BODY}"),
    (f"<div class='a'>{LONG}</div><div class='b'>{LONG}</div><div class='c'><p>The end.</p></div>", f"{BODY}\n{BODY}\nThe end."),
    (f"<p>Before</p><table><tr><td>{BODY}</td><td>12</td></tr></table><p>After</p>", f"Before\n{BODY}\n12\nAfter"),
    (f"Beside<section>{LONG}</section>", f"Beside\n{BODY}"),
    (f"<div class='in'><div class='entry'>{LONG}</div></div><div class='by'>by me</div><div class='t'><h2>Head</h2></div>",
     f"{BODY}\nby me\nHead"),
])
def test_parts_without_an_article_element(inner, want):
    for html in (page(f"<div class='post'>{inner}</div>"), page(inner)):
        p = hx.Page(html)
        votes = p.votes()
        assert p.text(None) == p.text(max(votes, key=lambda x: (votes[x], x))) == want


def test_headline_beside_the_article_element():
    assert hx.Page(page(f"<main><div class='t'><h1>Head</h1></div><article>{LONG}</article></main>")).text(None) == f"Head\n{BODY}"
    assert hx.Page(page(f"<p>Site words.</p><article><h1>Head</h1>{LONG}</article>")).text(None) == f"Head\n{BODY}"


def test_pages_without_a_lead_do_not_outvote_those_with_one(spark):
    entry = f"<div class='entry'>{LONG}</div>"
    rows = [(i, f"http://a.example/{i}", page(f"<div class='post'>{lead if i == 0 else ''}{entry}</div>"))
            for i, lead in enumerate(["<div class='lead'><p>Some lead.</p></div>"] * 5)]
    got = {r.page_id: r.text for r in hx.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: f"Some lead.\n{BODY}"} | dict.fromkeys(range(1, 5), BODY)


@pytest.mark.parametrize("html", [
    page(f"<div class='content no-sidebar'>{ARTICLE}</div>"), page(f"<div id='content-sidebar-wrap'>{ARTICLE}</div>"),
    page(f"<main class='has-sidebar'>{ARTICLE}</main>"), page(f"<article class='post comments-open'>{ARTICLE}</article>"),
    page(f"<div class='with-widgets nav-open has-header'>{ARTICLE}</div>"), page(f"<main id='main-menu'>{ARTICLE}</main>"),
    page(f"<article class='post sponsored-post share-top'>{ARTICLE}</article>"),
    f"<html class='no-js cookies'><head><title>T</title></head><body class='sidebar'><div>{ARTICLE}</div></body></html>",
    f"<html><head><title>T</title><meta charset='utf-8'><body>{ARTICLE}</body></html>",
    f"<html><head><title>T</title><link rel='x'><div>{ARTICLE}</div></html>",
    page(f"<div class='post'><header class='entry-header'><h1>Title &amp; more</h1></header>{ARTICLE[ARTICLE.index('<p>'):]}</div>"),
    page(f"<div class='post'><div class='post-header'><h1>Title &amp; more</h1></div>{ARTICLE[ARTICLE.index('<p>'):]}</div>"),
    page(f"<form id='aspnet'><div class='menu'>A menu</div><div>{ARTICLE}</div></form>"),
    page(f"<nav>Home</nav><div class='notice'>{ARTICLE}</div>"), page(f"<nav>{ARTICLE}</nav>"),
])
def test_names_that_only_mention_a_noise_part(html):
    assert hx.Page(html).text(None) == TEXT


def test_text_in_a_head_without_an_end():
    assert hx.Page("<head><title>T</title> Some <b>text</b>").text(None) == "Some text"


@pytest.mark.parametrize("name", ["sidebar-2", "comment-list", "site-footer", "main-nav", "left-sidebar", "related-posts", "ad_slot_3",
                                  "post-comments", "main-header", "page-header", "entry-footer", "share-buttons", "cookie-notice"])
def test_known_forms_of_noise_names(name):
    assert hx.Page(page(f"<div class='{name}'><p>Some other words, ending here.</p></div><div class='post'>{ARTICLE}</div>")).text(None) == TEXT


@pytest.mark.parametrize("html", [
    '<p class=a">One.</p><p>Two is here.</p><p class=b">Three.</p>', '<p title="5" wide">One.</p><p>Two is here.</p><p title="a > b">Three.</p>',
    "<p data-x=it's>One.</p><p>Two is here.</p><p data-x=it's>Three.</p>", '<p "a">One.</p><p =">Two is here.</p><p>Three.</p>',
    "<p a = 'x>y' b=\"'\">One.</p><p a= >Two is here.</p><p a>Three.</p>"])
def test_stray_quotes_lose_no_block(html):
    assert hx.Page(html).text(None) == "One.\nTwo is here.\nThree."


@pytest.mark.parametrize("html", [
    "<i>" * 333_333 + "x", "<i>" * 150_000 + "<div></div>" * 50_000, "<h1>" * 120_000 + "<div></div>" * 50_000, "<div>" * 200_000 + "x",
    "<div>x" * 160_000, "<svg>" * 200_000, "<i>" * 160_000 + "</b>" * 130_000, '<p a="' * 150_000, "<p a='b\" c=\"d'" * 60_000,
    "<p " + "=" * 900_000, "<" * 1_000_000, "<!--" * 250_000, f"<div class='{' '.join(f'c{i}' for i in range(150_000))}'>x"])
def test_a_megabyte_of_odd_markup_takes_seconds(html):
    import time

    began = time.process_time()
    p = hx.Page(html)
    p.votes()
    p.text("body>div")
    assert time.process_time() - began < 15


def test_deep_pages_take_memory_in_proportion():
    import tracemalloc

    tracemalloc.start()
    p = hx.Page("<div>" * 100_000 + "x")
    assert len(p.votes()) == 100_001 and p.text(None) == "x"
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000


def plain_blocks(html):
    """(path as a tuple of labels, text, link characters, heading) of a well-formed page without noise, by a plain walk."""
    from html.parser import HTMLParser

    out, open_, held = [], [], []

    def flush():
        text = " ".join("".join(t for t, _ in held).split())
        if text:
            path = ("body", *(x[1] for x in open_ if x[0] in hx.CONTAINER))
            last = [x[0] for x in open_ if x[0] in hx.CONTAINER or x[0] in hx.HEADINGS]
            heading = last[-1] if last and last[-1] in hx.HEADINGS else ""
            out.append((path, text, sum(len(t.strip()) for t, linked in held if linked), heading))
        held.clear()

    class Walk(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag in hx.BLOCK:
                flush()
            classes = {re.sub(r"\d+", "#", c) for c in (dict(attrs).get("class") or "").split()}
            open_.append((tag, ".".join([tag, *sorted(classes)])))

        def handle_endtag(self, tag):
            if tag in hx.BLOCK:
                flush()
            open_.pop()

        def handle_data(self, data):
            held.append((data, any(x[0] == "a" for x in open_)))

    Walk().feed(html)
    flush()
    return out


def plain_vote(html):
    """The paths that a page votes for, with every total summed anew over all blocks."""
    blocks = plain_blocks(html)
    seen = []  # in order of the first container, as far as blocks show it
    for path, *_ in blocks:
        for n in range(1, len(path) + 1):
            if path[:n] not in seen:
                seen.append(path[:n])

    def inside(p):
        return [b for b in blocks if b[0][:len(p)] == p]

    def total(p):
        return sum(max(0, len(b[1]) - b[2]) for b in inside(p))

    def deepest(p, kinds=None):
        whole, found = total(p), p
        while True:
            below = [q for q in seen if q[:-1] == p]
            if not below:
                return found
            p = max(below, key=total)
            if 100 * total(p) < 90 * whole:
                return found
            if kinds is None or p[-1].split(".")[0] in kinds:
                found = p

    if not total(("body",)):
        return []
    marks = [p for p in seen if p[-1].split(".")[0] in ("article", "main") and 2 * total(p) >= total(("body",))]
    if marks:
        pick = deepest(min(marks, key=lambda p: (len(p), -total(p))), ("article", "main"))
    else:
        pick = deepest(("body",))
    start = pick
    for n in range(len(start) - 1, 0, -1):
        above = start[:n]
        more = [b for b in inside(above) if b not in inside(pick) and 2 * b[2] <= len(b[1])]
        has = {b[3] for b in inside(pick)} - {""}
        climb = "h1" not in has and any(b[3] == "h1" for b in more)
        if marks:
            climb = climb and (above[-1].split(".")[0] in ("article", "main") or not has)
        else:
            step = [b for b in inside(above) if b not in inside(start[:n + 1]) and 2 * b[2] <= len(b[1])]
            climb = bool(step) and (climb or any(b[0] == above for b in step) or any(b[3] or b[1].endswith(hx.ENDS) for b in more)
                                    or sum(len(b[1]) - b[2] for b in more) >= hx.PART_CHARS)
        if climb:
            pick = above
    out = [pick]
    while len(out[-1]) > 1 and inside(out[-1][:-1]) == inside(pick):
        out.append(out[-1][:-1])
    return [">".join(p) for p in out]


def random_page(r, host):
    serial = iter(range(10_000))

    def words(n):
        return " ".join(r.choice(("lorem", "ipsum", "dolor", "sit")) for _ in range(n)) + f" {next(serial)}"

    def inner(depth):
        out = []
        for _ in range(r.randint(1, 3)):
            kind = r.choice(("p", "p", "div", "div", "h1", "h2", "a", "section", "article" if host % 2 else "div"))
            if kind in ("div", "section", "article") and depth < 4:
                out.append(f"<{kind} class='{r.choice(('x', 'y', 'z-7'))}'>{inner(depth + 1)}</{kind}>")
            elif kind == "a":
                out.append(f"<p><a href='u'>{words(3)}</a></p>")
            else:
                tag = kind if kind in ("h1", "h2") else "p"
                out.append(f"<{tag}>{words(r.choice((1, 4, 40)))}{r.choice(('.', ''))}</{tag}>")
        return "".join(out)

    return inner(0)


def test_picks_and_texts_equal_a_plain_walk(spark):
    r = random.Random(4)
    pages = [(i, f"http://h{i % 4}.example/", random_page(r, i % 4)) for i in range(240)]
    votes = {}
    for _, url, html in pages:
        want = plain_vote(html)
        assert hx.Page(html).picks() == want, html
        for p in want:
            votes.setdefault(url, {}).setdefault(p, 0)
            votes[url][p] += 1
    winner = {url: max(v, key=lambda p: (v[p], p)) for url, v in votes.items()}
    got = {x.page_id: x for x in hx.extract_text(
        spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("x"))).collect()}
    for i, url, html in pages:
        assert got[i].path == winner[url]
        blocks = plain_blocks(html)
        for path in (winner[url], *plain_vote(html)[:1], "body"):
            chosen = [b[1] for b in blocks if ">".join(b[0]) == path or ">".join(b[0]).startswith(path + ">")]
            if chosen:
                break
        assert got[i].text == "\n".join(chosen)
