import random
import time

import pytest

from parley.llm import maintext

LONG = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor. " * 3
CLEAN = LONG.strip()


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_article_without_its_surroundings():
    html = page(
        f"""<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav>
        <div class="cookie-notice">We use cookies, {LONG}</div><div id="content"><h1>T &amp; U</h1><p>{LONG}</p>
        <script>var a = "<p>{LONG}</p>";</script><p>Short.</p><div class="ad">Buy, now</div><ul><li>one</li><li>two</li></ul>
        <!-- <p>hidden</p> --><p>x&nbsp;&#233;<br>y   z</p></div><div class="sidebar"><p>{LONG}</p></div>
        <section id="comments"><p>{LONG}</p></section><form><p>{LONG}</p></form><footer>f</footer>"""
    )
    assert maintext.main_text(html) == f"T & U\n{CLEAN}\nShort.\none\ntwo\nx é y z"


def test_headers_of_the_page_and_of_the_article():
    html = page(f'<div class="page-header">Site</div><article><div class="entry-header"><h1>A</h1></div><p>{LONG}</p></article>')
    assert maintext.main_text(html) == f"A\n{CLEAN}"


def test_unclosed_tags():
    html = page(f"<article><h1>A</h1><p><b>{LONG}<br><p>{LONG}</p><p>end</article><footer>no</footer>")
    assert maintext.main_text(html) == f"A\n{CLEAN}\n{CLEAN}\nend"


def test_siblings_of_the_best_container():
    html = page(f"<div><div><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG}</p></div><div><a href=x>{LONG}</a></div></div>")
    assert maintext.main_text(html) == "\n".join([CLEAN] * 3)


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("<p>Hello</p>", "Hello"),
        ("a < b & c", "a < b & c"),
        ("<!--", ""),
        ("<script>", ""),
        ("<![CDATA[x]]>y", "xy"),
        ("<nav>menu</nav>", ""),
        ("<p>one<p>two", "one\ntwo"),
        ("&#0;&bogus;&lt;p&gt;", "�&bogus;<p>"),
    ],
)
def test_odd_input(html, want):
    assert maintext.main_text(html) == want


def test_deep_and_long():
    assert maintext.main_text("<div>" * 20_000 + "deep") == "deep"
    assert maintext.main_text(page("<p>" + "word, " * 100_000 + "</p>")) == ("word, " * 100_000).strip()


@pytest.mark.parametrize(
    "part, then",
    [("<div>", "</section>"), ("<div>", "</b>"), ("<a href='x ", ""), ("<a", ""), ("<a b='>' ", ""), ("<!", ""), ("</", ""),
     ("<b>", "<hr>"), ("<ul><b>", "<li></li>"), ("<b><div><i>", "</b>"), ("<div><table><b>", "</div>"), ("<p x=\"", "'>"), ("= ", "<x ")],
)
def test_hostile_pages(part, then):
    n = 1_000_000 // len(part + then)
    for html in ((part + then) * n, part * n + then * n):
        begin = time.process_time()
        maintext.parse(html)
        assert time.process_time() - begin < 10


def test_unfinished_tags():
    assert maintext.main_text("<p>one <a href='x</p><p>two</p>") == "one\ntwo"
    assert maintext.main_text("<p>one</p><a href='x") == "one\n<a href='x"


TAGS = ["div", "p", "b", "i", "li", "ul", "table", "tr", "td", "section", "span", "hr", "br", "dl", "dt", "dd"]


def walked(tags):
    """Parents of the elements, by walks over all that are open."""
    stack, out = [("#root", -1)], []
    for n, (end, name) in enumerate(tags):
        def up(hit, stop):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in hit:
                    del stack[k:]
                    return
                if stop(stack[k][0]):
                    return
        if end:
            table = name in ("div", "p", "li")
            up({name}, lambda t: (name not in maintext.BLOCK and t in maintext.BLOCK) or (table and t == "table"))
            continue
        if name in maintext.BLOCK:
            up({"p"}, lambda t: t in maintext.BLOCK or t in maintext.P_STOPS)
        if name in maintext.ENDS:
            up(maintext.ENDS[name][0], lambda t: t in maintext.ENDS[name][1])
        out.append((n, name, stack[-1][1]))
        if name not in maintext.VOID:
            stack.append((name, n))
    return out


def test_trees_against_walks():
    rng = random.Random(4)
    for _ in range(400):
        tags = [(rng.random() < 0.4, rng.choice(TAGS)) for _ in range(rng.randrange(60))]
        root = maintext.parse("".join(f"</{t}>" if end else f"<{t} n={n}>" for n, (end, t) in enumerate(tags)))
        number = lambda node: int(node.attrs.split("=")[1]) if node.attrs else -1
        got = [(number(x), x.tag, number(x.parent)) for x in maintext._ordered(root)[1:]]
        assert sorted(got) == walked(tags)


def test_query(spark):
    schema = "page_id long, url string, html string, text string, n_chars long, _html string"
    rows = [(1, None, None, "x", 5, "y"), (2, "u", page(f"<article><p>{LONG}</p></article>"), "x", 5, "y"), (2, "u", "é", None, None, None), (None, "v", "", "x", 1, "")]
    got = maintext.pages_query(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, None, "", 0), (2, "u", CLEAN, len(CLEAN)), (2, "u", "é", 1), (None, "v", "", 0)], key=str)
    assert maintext.pages_query(spark.createDataFrame([], schema)).count() == 0
