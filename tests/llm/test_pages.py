"""Labelled pages: the exact main text that the rules have to give."""

import pytest
from pyspark.sql import functions as F

from filigree.llm import pages

A = "This is the first paragraph of the article and it has enough of the words that are usual in a text to be told apart."
B = "The second paragraph goes on with the story, and again it is long enough that nobody takes it for a caption or a button."
X = "This is something else that stands on the page, it is as long as a paragraph of the article and has as many usual words."
BODY = f"<p>{A}</p><p>{B}</p>"
TEXT = f"{A}\n{B}"


def _article(extra: str) -> str:
    return f"<body><article>{BODY}{extra}</article></body>"


def _plain(extra: str) -> str:
    return f"<body><div class=content>{BODY}</div>{extra}</body>"


COMMENTS = [
    "<div class='comments-area'><p>{X}</p></div>", "<ol class='comment-list'><li>{X}</li></ol>", "<section id=disqus_thread><p>{X}</p></section>",
    "<div class='user-comments'><p>{X}</p></div>", "<div id=respond><p>{X}</p></div>", "<div class='post-comments'><div class=comment-body>{X}</div></div>",
    "<ul class=commentList><li id=comment-12>{X}</li></ul>", "<div class=readerComments>{X}</div>",
]
ADVERTS = [
    "<div class=adbox><p>{X}</p></div>", "<div class='ad-slot'><p>{X}</p></div>", "<div class='top-ad'>{X}</div>", "<div class=adContainer>{X}</div>", "<div id='google_ads_300x250'>{X}</div>",
    "<section class=sponsored-content>{X}</section>", "<div class='gdpr-banner'>{X}</div>", "<div id=cookie-notice>{X}</div>", "<div class=copyright>{X}</div>",
]
HIDDEN = [
    "<p hidden>{X}</p>", "<div style='color:red; display: none'><p>{X}</p></div>", "<div aria-hidden=true>{X}</div>", "<p style=\"visibility:hidden\">{X}</p>", "<p><span hidden>{X} <span>{X}</span></span></p>",
    "<section hidden=until-found><p>{X}</p></section>",
]


@pytest.mark.parametrize("extra", COMMENTS + ADVERTS + HIDDEN)
@pytest.mark.parametrize("around", [_article, _plain])
def test_what_is_no_main_text(around, extra):
    assert pages.main_text(around(extra.replace("{X}", X))) == TEXT


#: Elements whose names or attributes hold a word of furniture and that are main text all the same.
KEPT = [
    (f"<article class='post has-comments comments-open'>{BODY}</article>", TEXT),
    (f"<div class='post no-comments'>{BODY}</div>", TEXT),
    (f"<article><h2 id=ad-hoc-networks>Ad hoc networks</h2>{BODY}</article>", f"Ad hoc networks\n{TEXT}"),
    (f"<article><section id=comments-on-the-method>{BODY}</section></article>", TEXT),
    (f"<article><section id=copyright-law>{BODY}</section></article>", TEXT),
    (f"<article data-id=comments><div data-class='ad'>{BODY}</div></article>", TEXT),
    (f"<article><div title='hidden' data-style='display:none'>{BODY}</div></article>", TEXT),
    (f"<article><p aria-hidden=false>{A}</p><p style='display:block'>{B}</p></article>", TEXT),
    (f"<body style='visibility:hidden'><div id=app style='display:none'>{BODY}</div></body>", TEXT),
    (f"<article><p>{A} <i aria-hidden=true>*</i><b>bold</b></p></article>", f"{A} bold"),
    (f"<article><p>{A}<span hidden>x</p><p>{B}</p></article>", TEXT),
    (f"<div class=broadcast-adapter>{BODY}</div>", TEXT),
]


@pytest.mark.parametrize("page,text", KEPT)
def test_what_is_main_text(page, text):
    assert pages.main_text(page) == text


LONGER = BODY * 3
#: Teasers beside the story; parts of a story that are articles themselves stay.
SEVERAL = [
    (f"<article>{LONGER}</article><article><h3><a href=x>Next</a></h3><p>{X}</p></article>", "\n".join([TEXT] * 3)),
    (f"<main><article>{LONGER}</article><article><p>{X}</p></article></main>", "\n".join([TEXT] * 3)),
    (f"<article><p>{X}</p><p><a href=x>Read more</a></p></article><article>{LONGER}</article>", "\n".join([TEXT] * 3)),
    (f"<article>{BODY}</article><article>{BODY}</article>", f"{TEXT}\n{TEXT}"),
    (f"<article>{LONGER}</article><article><h2>Part</h2><p>{A}</p><p>End</p></article>", "\n".join([TEXT] * 3) + f"\nPart\n{A}\nEnd"),
]


@pytest.mark.parametrize("page,text", SEVERAL)
def test_several_articles(page, text):
    assert pages.main_text(page) == text


def test_page_text_of_empty_tables_nulls_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, _article("")), (3, _article("")), (4, _plain("<p hidden>x</p>" + f"<p>{'word ' * 100_000}</p>"))]
    table = spark.createDataFrame(rows, "page_id long, html string")
    got = sorted((r.page_id, r.text) for r in table.select("page_id", pages.page_text(F.col("html")).alias("text")).collect())
    assert got[:4] == [(1, ""), (2, ""), (3, TEXT), (3, TEXT)]
    assert got[4][1] == TEXT + "\n" + ("word " * 100_000).strip()
    assert table.where("false").select(pages.page_text(F.col("html")).alias("text")).count() == 0
