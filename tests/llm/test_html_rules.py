"""Block rules on pages made by hand, whose main text was marked by hand."""

import time

import pytest

from pagelight.llm.html_text import extract

LONG = "The house of the man was in the town and it was old, so that the people of the town had seen it for a long time. " * 2
WHOLE = " ".join(LONG.split())
P = f"<p>{LONG}</p>"

#: page, main text
CASES = {
    "a paragraph of one link belongs to the article": (f"<article>{P}<p><a href=x>See the full report</a></p>{P}</article>", f"{WHOLE}\nSee the full report\n{WHOLE}"),
    "a list of links doesn't": (f"<article>{P}<ul><li><a href=x>One more story</a></li><li><a href=y>Another one</a></li></ul></article>", WHOLE),
    "nor does a call": (f"<article>{P}<div>Subscribe to our newsletter for more</div>{P}</article>", f"{WHOLE}\n{WHOLE}"),
    "a heading over links is nearer to them": (f"<article>{P}<p>It is short.</p><div>More of this</div><div><a href=x>a story of the town</a></div><div><a href=x>a story of a man</a></div></article>", f"{WHOLE}\nIt is short."),
    "short blocks between good ones": (f"<article>{P}<div>Yes.</div>{P}</article>", f"{WHOLE}\nYes.\n{WHOLE}"),
    "an advert in an article changes nothing for its neighbours": (f"<article><h1>Head</h1><div class=ad>Buy this now</div>{P}</article>", f"Head\n{WHOLE}"),
    "an article of one short line": ("<body><nav>Home</nav><article><p>It rains.</p></article></body>", "It rains."),
    "no article": (f"<body><div id=nav-menu>Menu</div><div>{LONG}</div><div>It is short</div><div>{LONG}</div><ul><li><a href=x>Home page of it</a></li></ul></body>", f"{WHOLE}\nIt is short\n{WHOLE}"),
    "no article: what stands before the text": (f"<body><div>Site of the town</div><div><a href=a>Home</a></div><div>{LONG}</div></body>", WHOLE),
    "no article: headings next to text": (f"<body><div><a href=a>Home</a></div><h2>Of the house</h2><div>{LONG}</div><h2>Of the man</h2><div>{LONG}</div></body>", f"Of the house\n{WHOLE}\nOf the man\n{WHOLE}"),
    "reader comments": (f"<article>{P}<section class=comments><p>{LONG}</p></section></article>", WHOLE),
    "an unclosed title": (f"<html><head><title>T<body><article>{P}</article></body>", WHOLE),
    "an unclosed noscript, textarea and iframe": (f"<body><article><noscript>{P}<textarea>{P}<iframe src=x>{P}</article>", f"{WHOLE}\n{WHOLE}\n{WHOLE}"),
    "a quote that stays open": (f"<article>{P}<p class=\"x>{WHOLE}</p>", f"{WHOLE}\n{WHOLE}"),
    "an unclosed script": (f"<article>{P}<script>var a = 1;", WHOLE),
    "text in a language without known stop words": ("<article><p>" + "talo kissa koira " * 20 + "</p></article>", ("talo kissa koira " * 20).strip()),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    page, text = CASES[name]
    assert extract(page) == text


@pytest.mark.parametrize("page", ["<b></i>" * 60_000, "<b>" * 60_000 + "</i>" * 60_000, "<div>" * 100_000 + "x", "<p><a>x" * 40_000, "<title>" * 60_000, "<b>" * 30_000 + "<p></p>" * 30_000, "<a title=\"" * 50_000, "<li><ul>" * 50_000 + "</ul></li>" * 50_000])
def test_odd_markup_takes_linear_time(page):
    began = time.time()
    extract(page)
    assert time.time() - began < 10


PROSE = "The committee met on Tuesday and it was decided that the plan for the new bridge would be sent to the council for a vote in the spring of next year. "
LAYOUTS = ["has-sidebar", "side-by-side", "legal-analysis", "no-comments", "with-ads", "related-content", "hidden-xs", "page-menu-open", "content share", "layout sidebar"]


@pytest.mark.parametrize("name", LAYOUTS)
def test_names_of_layouts_hide_no_text(name):
    around = f'<nav><a href=a>Home</a></nav><div id="page" class="{name}"><article><h1>Title</h1><p>{PROSE}</p></article></div><div class="footer">About us</div>'
    assert extract(around) == f"Title\n{PROSE.strip()}"
    alone = f'<nav><a href=a>Home</a></nav><div class="{name}"><p>{PROSE * 2}</p></div><div class="footer">About us</div>'
    assert extract(alone) == (PROSE * 2).strip()
    inside = f'<article><div class="{name}"><p>{PROSE * 2}</p></div><p>{PROSE}</p></article>'
    assert extract(inside) == f"{(PROSE * 2).strip()}\n{PROSE.strip()}"


@pytest.mark.parametrize("name", ["sidebar", "comments", "comment-list", "site-footer", "cookie-notice", "newsletter-signup", "related-posts", "ad-box", "share-buttons", "hidden", "legal notice"])
def test_names_of_boilerplate(name):
    assert extract(f'<article><p>{PROSE * 3}</p><div class="{name}"><p>{PROSE}</p></div></article>') == (PROSE * 3).strip()


def test_long_comments_stay_comments():
    assert extract(f'<article><p>{PROSE * 2}</p><section id="comments"><p>{PROSE * 20}</p></section></article>') == (PROSE * 2).strip()


@pytest.mark.parametrize("text", ["委员会星期二开会，决定将新桥梁的计划提交给市议会，在明年春天进行投票。" * 8, "Komitet spotkał się we wtorek i postanowił, że plan budowy nowego mostu zostanie przesłany radzie miasta do głosowania wiosną przyszłego roku. " * 3])
def test_languages_without_stop_words(text):
    page = f"<nav><a href=a>Start</a> <a href=b>News</a></nav><div><p>{text}</p><p>Menu</p></div><div><a href=c>link one</a> <a href=d>link two</a></div>"
    assert extract(page).startswith(text.strip())
