"""Pages whose own class names or embedded drawings must not cost their article."""

import pytest

from lamella.llm import html
from tests.llm.test_html import FRAME, LONG

ARTICLE = f"<article><p>{LONG}</article>"


@pytest.mark.parametrize("page", [
    f'<html class="no-search"><body class="single-post has-sidebar sidebar">{ARTICLE}',
    f'<body id="side"><main class="nav search">{ARTICLE}</main>',
    f'<article class="post tags related"><p>{LONG}</article>',
    f'<body><div class="content has sidebar"><div id="share">{ARTICLE}</div></div>',
    f'<article><svg width="1"/><math/><p>{LONG}</article>',
    f'<article><svg><path/><p>{LONG}</article>',
    f'<article><svg><text>x</text></svg><p>{LONG}</article><script>a',
])
def test_article_stays(page):
    assert html.main_text(page) == LONG.strip()


def test_boilerplate_goes():
    assert html.main_text(f"<body><article hidden><p>{LONG}</article>") == ""
    assert html.main_text(f'<body><nav class="menu">{ARTICLE}</nav>') == ""
    assert html.main_text(FRAME.format(f'{ARTICLE}<div class="related"><article>x y</article></div>')) == LONG.strip()


def test_names_made_of_prose_cost_no_text():
    import random

    line = "The search for the lost city went on for as long as there was hope for it and for the men who had gone there. "
    for page in (f'<article><p class="search">{line}</p></article>', f'<article><div class="social-history"><p>{line}</p></div></article>', f'<article><div id="search"><p>{line}</p></div></article>'):
        assert html.main_text(page) == line.strip()
    assert html.main_text("<article><p>See <a href=x>the long list of all that is in the book and of what it has to say to you</a></p></article>").startswith("See the long list")
    refs = "".join(f"<li><a href=x>Reference {i} to the book of the year</a></li>" for i in (1, 2))
    assert html.main_text(f"<article><ol>{refs}</ol><p>The end of the long story of the two old friends.</p></article>") == "The end of the long story of the two old friends."
    rng, words = random.Random(0), [w.lower().strip(".") for w in line.split()]
    for _ in range(300):
        name = "-".join(rng.choices([*words, "share", "reply", "menu", "tags", "ads"], k=2) + [rng.choice(words)])
        tag = rng.choice(["p", "div", "section", "li"])
        if not set(name.split("-")) <= {"share", "reply", "menu", "tags", "ads", "search", "the"}:
            assert html.main_text(f'<article><{tag} class="{name}">{line}</{tag}></article>') == line.strip(), name


def test_layout_names_inside_articles_go():
    for name in ("comments", "comment-list", "ad-slot", "newsletter box", "sidebar_left", "promo"):
        assert html.main_text(f'<article><p>{LONG}</p><div class="{name}"><p>{LONG}</p></div></article>') == LONG.strip(), name
    for name in ("share-buttons", "related-posts", "tags", "post-tags", "search-box"):
        assert html.main_text(f'<article><p>{LONG}</p><div class="{name}"><p>Share it with all</p><a href=x>of the day</a></div></article>') == LONG.strip(), name
