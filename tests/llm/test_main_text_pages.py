"""Main text: which part of a page is the article follows from its paths, and nothing of the article is left out."""

import time
from html.parser import HTMLParser

import pytest

from relops.llm.main_text import extract_main_text, main_text

SENTENCE = "One sentence, of a few words."
LONG = " ".join([SENTENCE] * 6)


def paragraphs(count, text=LONG):
    return "".join(f"<p>{text}</p>" for _ in range(count))


@pytest.mark.parametrize(
    "page, want",
    [
        # Names that contain a word for what is around an article, inside one.
        (
            f'<nav><a href="/">Home</a></nav><article><div class="article-header"><h1>Title</h1></div><h2 id="legal-basis">Legal</h2><section id="search-engines">{paragraphs(2)}</section></article>',
            ["Title", "Legal", LONG, LONG],
        ),
        # Short lists, cells and quotes, and blocks of links, stand in the article too.
        (
            f'<article><h1>T</h1>{paragraphs(3)}<ul><li>ab</li><li><a href="/x">only a link</a></li></ul><table><tr><td>x1</td><td>2</td></tr></table><blockquote>So.</blockquote></article>',
            ["T", LONG, LONG, LONG, "ab", "only a link", "x1", "2", "So."],
        ),
        # A teaser in an article element beside the text in a plain one.
        (f"<body><article><p>Teaser, small.</p></article><div>{paragraphs(20)}</div></body>", [LONG] * 20),
        # Comments longer than the article, a side bar, a notice and an advert, by their names.
        (
            f'<article><h1>T</h1>{paragraphs(2)}<div class="comments-area">{paragraphs(4)}</div></article><section id="comments">{paragraphs(30)}</section>'
            f'<div class="cookie-notice">We use, cookies.</div><div class="sidebar">{paragraphs(9)}</div><div class="ad-slot">{paragraphs(3)}</div><div role="complementary">{LONG}</div>',
            ["T", LONG, LONG],
        ),
        # No element with a telling name at all.
        (
            f'<html><body><div>Home | About</div><div><h1>T</h1><div>{paragraphs(2)}</div><div><p>Short.</p></div></div><div><a href="/1">one</a> <a href="/2">two</a></div></body></html>',
            ["T", LONG, LONG, "Short."],
        ),
        ("<p>Plain, but text.</p><p>a", ["Plain, but text.", "a"]),
        (f"<h1>Head</h1><main>{paragraphs(2)}</main>", ["Head", LONG, LONG]),
        ("just text &amp; no tag", ["just text & no tag"]),
        ("<nav>only a menu</nav>", []),
        ("", []),
        (None, []),
    ],
)
def test_pages(page, want):
    assert main_text(page) == "\n".join(want)


class Article(HTMLParser):
    """Text between block tags of the one article of a page, by the standard library."""

    def __init__(self):
        super().__init__()
        self.inside, self.skipped, self.parts, self.blocks = False, 0, [], []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.blocks += [text] if text and self.inside else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in ("script", "style")
        if tag == "br":
            self.parts.append(" ")
        elif tag not in ("b", "a", "i", "em", "span"):
            self.flush()
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        self.skipped -= tag in ("script", "style")
        if tag not in ("b", "a", "i", "em", "span"):
            self.flush()
        self.inside &= tag != "article"

    def handle_data(self, data):
        if not self.skipped:
            self.parts.append(data)


def test_given_pages(spark):
    """Every page of the table has one article: its text, whole."""

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages).collect()}
    for row in pages.collect():
        parser = Article()
        parser.feed(row["html"] or "")
        parser.close()
        assert got[row["page_id"]] == "\n".join(parser.blocks)


def test_names_do_not_decide_where_ratios_can(spark):
    """The same pages with every article element a plain one: the text is found by its paths alone."""

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").filter("html is not null").collect()
    plain = [(r["page_id"], r["html"].replace("<article>", "<div>").replace("</article>", "</div>")) for r in pages]
    found = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(plain, "page_id long, html string"), keep=["page_id"]).collect()}
    same = sum(found[r["page_id"]] == main_text(r["html"]) for r in pages)
    assert same >= 0.9 * len(pages)


@pytest.mark.parametrize(
    "page", ["<div>", "<b>", "<p>x</p></i>", "<x-a>", "<li></li>", '<a "', "<svg/>", "<!--", "&", "<td>x", "x ", '<div class="ad">'], ids=range(12)
)
def test_hostile_pages_take_time_by_their_length(page):
    """Deep nesting, unclosed and unopened tags: ten times the page takes no more than some thirty times as long."""

    def seconds(count):
        begun = time.perf_counter()
        main_text("<p><div>" + "<b>" * count + page * count)
        return time.perf_counter() - begun

    seconds(500)
    assert seconds(20_000) < 30 * max(seconds(2_000), 0.01)


def test_clashing_columns_ties_and_repeats(spark):
    page = f"<article>{paragraphs(1)}</article>"
    rows = [(1, "u", page, "old"), (1, "u", page, "old"), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    made = extract_main_text(frame, keep=["page_id", "url", "text", "html"])
    assert made.columns == ["page_id", "url", "html", "text"]
    assert sorted([r["text"] for r in made.collect()]) == ["", LONG, LONG] and extract_main_text(frame.limit(0)).count() == 0
