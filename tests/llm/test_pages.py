"""Main text where comments outweigh it, names come in parts, main elements have articles beside them, and pages have no article at all."""

import pyarrow.parquet as pq
import pytest

from corpusloom.llm import html_text
from tests.llm import brute

TEXTS = [f"Paragraph {i}, with a good many words, and marks." for i in range(2)]
P = "".join(f"<p>{t}</p>" for t in TEXTS)
OTHER = "".join(f"<p>Remark {i}, with a good many words, and marks in it.</p>" for i in range(12))


@pytest.mark.parametrize("page", [
    f"<body><article><h1>T</h1>{P}</article><section id='comments'>{OTHER}</section></body>",
    f"<body><div><h1>T</h1>{P}</div><section id='comments'>{OTHER}</section></body>",
    f"<body><div><h1>T</h1>{P}</div><section id='comments'><h1>Comments</h1>{OTHER}</section></body>",
    f"<body><article><h1>T</h1>{P}</article><article class='comment'>{OTHER}</article></body>",
    f"<body><div class='comments'><main><h1>T</h1>{P}</main></div></body>",
])
def test_comments_are_never_text(page):
    assert html_text.main_blocks(page) == ["T", *TEXTS]


def test_page_of_comments_only():
    assert html_text.main_blocks(f"<body><section class='comments'>{OTHER}</section></body>") == []


@pytest.mark.parametrize("name", ["user-comments", "comment-thread", "userComments", "reader_comments", "related-posts", "relatedArticles", "ad-slot", "adbox", "ads-unit", "advert top", "sponsored-content"])
def test_names_in_parts(name):
    assert html_text.main_blocks(f"<body><article><h1>T</h1>{P}<div class='{name}'>{OTHER}</div></article></body>") == ["T", *TEXTS]
    assert html_text.main_blocks(f"<body><div><h1>T</h1>{P}</div><div id='{name.split()[0]}'>{OTHER}</div></body>") == ["T", *TEXTS]


@pytest.mark.parametrize("name", ["comment-free", "has-ads", "address", "adventure", "uncommented", "additional", "news", "posts", "thread"])
def test_other_names_stay(name):
    assert html_text.main_blocks(f"<body><div class='{name}'><h1>T</h1>{P}</div></body>") == ["T", *TEXTS]


def test_main_before_articles_outside():
    teasers = "".join(f"<article><h3>Teaser {i}</h3><p>A teaser, of some words, and marks, that goes on.</p></article>" for i in range(9))
    assert html_text.main_blocks(f"<body><main><h1>T</h1>{P}</main><div>{teasers}</div></body>") == ["T", *TEXTS]
    assert html_text.main_blocks(f"<body><main><h1>T</h1><article>{P}</article></main><div>{teasers}</div></body>") == ["T", *TEXTS]


def test_titles():
    """A top heading before an article belongs to it, unless the article has its own."""
    assert html_text.main_blocks(f"<body><div><h1>T</h1></div><article>{P}</article></body>") == ["T", *TEXTS]
    assert html_text.main_blocks(f"<body><div><h1>Site</h1></div><article><h2>T</h2>{P}</article></body>") == ["T", *TEXTS]
    assert html_text.main_blocks(f"<body><header><h1>Site</h1></header><article><h1>T</h1>{P}</article></body>") == ["T", *TEXTS]


def test_pages_without_article(sf_dir, monkeypatch):
    """The table's pages with their article as a plain element, and adverts without a name: paths alone find the same text."""
    pages = [p or "" for p in pq.read_table(f"{sf_dir}/pages.parquet").column("html").to_pylist()]
    bare = [p.replace("<article>", "<div>").replace("</article>", "</div>").replace('class="ad"', 'class="x"') for p in pages]
    want = [brute.article_blocks(p) for p in pages]
    got = [html_text.main_blocks(b) for b in bare]
    # An advert of two sentences that nothing names can pass for a paragraph; all else is told apart, and no page loses text.
    assert all(set(w) <= set(g) and len(g) <= len(w) + 1 for g, w in zip(got, want))
    right = sum(g == w for g, w in zip(got, want))
    monkeypatch.setattr(html_text, "content_blocks", lambda blocks: blocks)
    off = sum(html_text.main_blocks(b) == w for b, w in zip(bare, want))
    assert right >= 0.7 * len(pages) and off < 0.1 * len(pages)
