"""Main text of pages whose markup is awkward, against what their generator put into the article."""

import random
import time

import pytest

from quarry.llm import pages

REAL = "Real words of the text, again and again here. " * 6
ARTICLE = f"<h1>Title of it</h1><p>{REAL}</p><p>Second one here.</p>"
TEXT = f"Title of it\n{REAL.strip()}\nSecond one here."


def main_text(html):
    return pages.main_text(html, pages.trained())


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar", "header-fixed", "nav-open", "page with-ads", "main-menu-open"])
@pytest.mark.parametrize("page", ['<body class="{0}"><nav><a href=x>Menu</a></nav><article>{1}</article><footer>f</footer>', "<body><div class='{0}'><nav><a href=x>Menu</a></nav><div>{1}</div><footer>f</footer></div>"])
def test_names_of_the_page_are_not_boilerplate(name, page):
    assert main_text(page.format(name, ARTICLE)) == TEXT


@pytest.mark.parametrize(("html", "want"), [
    (f"<body><form id=aspnetForm><input><nav><a href=x>M</a></nav><article>{ARTICLE}</article><footer>f</footer></form>", TEXT),
    (f"<body><form><main>{ARTICLE}</main></form><form><p>Search this site now.</p></form>", TEXT),
    (f"<article><h1>Title of it</h1><svg class=i /><p>{REAL}</p><title-bar></title-bar><p>Second one here.</p></article>", TEXT),
    (f"<article><h1>Title of it</h1><button-group></button-group><p>{REAL}</p><button>press<p>Second one here.</p></article><footer>ff</footer>", TEXT),
    (f"<article><h1>Title of it</h1><p title=don't>{REAL}</p><p>Second one<b title=isn't> here</b>.</p></article>", TEXT),
    (f"<body><header><h1>Site</h1><ul><li><a href=x>Home</a></ul></header><article><header><h1>Title of it</h1></header><p>{REAL}</p><p>Second one here.</p><footer>filed</footer></article>", TEXT),
    (f"<article>{ARTICLE}</article><section id=comments><article class='comment-body'><p>Nice post! I like it, really, so much of it.</p></article></section>", TEXT),
    (f"<article>{ARTICLE}<svg><path d='x'/><text>drawn</text></svg><math><mi>x</mi></math><select><option>a<option>b</select></article>", TEXT),
    (f"<article>{ARTICLE}<p hidden>{REAL}</p><p style='display: none'>{REAL}</p><template><p>{REAL}</p></template><noscript><p>{REAL}</p></noscript>", TEXT),
    (f"<article><!-- <p>x</p> --><!--><h1>Title of it</h1><!--->{ARTICLE[20:]}<!-- never closed <p>{REAL}</p>", TEXT),
    (f"<ARTICLE>{ARTICLE}<SCRIPT>var a = '<p>{REAL}</p></scripts>'</SCRIPT ><textarea><p>{REAL}</p></textarea></ARTICLE>", TEXT),
    (f"<article>{ARTICLE}<p>1 < 2, a<3 and <= 4; it &amp &#65;&lt;b&gt;.</p><p>cut <a href='", TEXT + "\n1 < 2, a<3 and <= 4; it & A<b>.\ncut"),
])
def test_awkward_markup(html, want):
    assert main_text(html) == want


def generated(r):
    """A page and the blocks of its article."""
    words = lambda a, b: " ".join("".join(r.choices("aeiouthnrs", k=r.randint(2, 8))) for _ in range(r.randint(a, b))) + "."
    attribute = lambda: r.choice(["", " class=lead", " data-x='a>b'", ' title="it\'s < that"', " title=don't", " id=p1 hidden-not", " CLASS = 'x y'"])
    links = "<ul>" + "".join(f"<li><a href=/x>{words(1, 3)}</a>" for _ in range(r.randint(2, 6))) + "</ul>"
    away = [f"<nav{attribute()}>{links}</nav>", f"<header>{links}</header>", f'<div class="{r.choice(["ad", "site-footer", "cookieNotice", "related-posts", "share_buttons"])}"><p>{words(3, 30)}</p></div>', f"<aside><p>{words(3, 30)}</p></aside>", f"<form>{words(1, 4)}<input></form>", f"<footer>{words(2, 9)}</footer>", f"<script>if (a < b) {{ '{words(3, 9)}' }}</script>", "<svg/>", "<!-- <p> -->"]
    r.shuffle(away)
    cut, html, want = r.randint(0, len(away)), [], []
    for k in range(r.randint(3, 9)):
        text = words(4, 9) if k == 0 else words(8, 60)
        tag = "h1" if k == 0 else r.choice(["p", "p", "p", "blockquote", "li"])
        middle = text.split(" ")
        at = r.randrange(len(middle))
        shown = " ".join([*middle[:at], r.choice(["<b>{}</b>", "<a href=/y>{}</a>", "<span\nclass='x'>{}</span>", "{}<!-- c -->", "<em>{}</em>"]).format(middle[at]), *middle[at + 1 :]])
        html.append(f"<{tag}{attribute()}>{shown}" + r.choice(["", " \n", f"</{tag}>", f"</{tag.upper()} >"]) * (tag not in ("h1", "blockquote")) + f"</{tag}>" * (tag in ("h1", "blockquote")))
        want.append(text)
    wrap = r.choice(["{}", "<div class='no-sidebar layout'>{}</div>", "<form id=f1>{}</form>", "<div id=header-fixed>{}</div>"])
    box = r.choice(["article", "main", "section role=main"])
    return f"<!DOCTYPE html><html class='no-js nav-open'><body{r.choice(['', ' class=has-sidebar'])}>" + wrap.format(f"{''.join(away[:cut])}<{box}>{''.join(html)}</{box.split()[0]}>{''.join(away[cut:])}"), "\n".join(want)


def test_generated_pages():
    r = random.Random(12)
    for _ in range(300):
        html, want = generated(r)
        assert main_text(html) == want, html


def test_cases_of_the_table(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "x"), (1, "u", f"<article>{ARTICLE}</article>", "x"), (1, "v", "<article><p>Another text of page one.</p></article>", "y"), (None, None, None, None), (2, "w", "", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted((tuple(x) for x in pages.extract(df).collect()), key=repr)
    assert got == sorted([(1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (1, "v", "Another text of page one.", 25), (None, None, "", 0), (2, "w", "", 0)], key=repr)
    assert pages.extract(df.limit(0)).count() == 0


def test_long_pages_take_time_by_their_length():
    took = []
    for n in (2000, 8000):
        began = time.time()
        assert main_text("<article>" + f"<p>{REAL}</p>" * n + "</article>").count("\n") == n - 1
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 2
    for odd in ("<a " * 200_000, "<!--" * 200_000, "<script>" + "</scrip" * 200_000, "<p class=" * 100_000, "<div>" * 20_000 + "x"):
        began = time.time()
        main_text(odd)
        assert time.time() - began < 20
