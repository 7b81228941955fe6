"""Main text: the registered rows against a plain parser, names of reader comments and adverts inside articles, deep markup and large pages."""

import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest

pytest.importorskip("framewright.llm")
from framewright.llm import html_main_text as H

FOLDER = "/root/testdata/sf0.001"


class Articles(HTMLParser):
    """Text of article elements, block by block; the tables' pages have no boilerplate in them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self._cut(tag)

    def handle_endtag(self, tag):
        self._cut(tag)
        self.depth -= tag == "article"

    def _cut(self, tag):
        if tag in ("article", "p", "h1", "h2", "ul", "ol", "li", "div", "nav", "footer"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data


def test_registered_rows_equal_a_plain_parser(spark):
    found = {r.page_id: (r.text, r.n_chars) for r in H.op8_html_extraction(spark, FOLDER).collect()}
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    assert len(found) == len(pages) > 20
    for r in pages:
        plain = Articles()
        plain.feed(r.html or "")
        plain.close()
        text = "\n\n".join(b for b in (" ".join(b.split()) for b in plain.blocks) if b)
        assert found[r.page_id] == (text, len(text)), r.page_id


BODY = "<p>The article goes on for some length here, so that it is most of what the page has.</p>" * 2
CERTAIN = [
    '<ol class="comment-list"><li id="comment-1">first!</li></ol>',
    '<div class="ad-slot">buy now</div>',
    '<div id="cookieNotice"><p>we use cookies</p></div>',
    '<section class="reader_comments"><h2>2 comments</h2><p>nice</p></section>',
    '<div class="newsletter-signup">sign up</div>',
    '<form><p>search</p></form>',
    '<aside>more</aside>',
    '<div class="post-sidebar">elsewhere</div>',
]


@pytest.mark.parametrize("piece", CERTAIN)
@pytest.mark.parametrize("page", ["<body><article>{a}{x}{b}</article></body>", "<body><main><div>{a}</div>{x}{b}</main></body>", "<body><div>{a}</div>{x}<div>{b}</div></body>"])
def test_comments_and_adverts_go_wherever_they_stand(page, piece):
    tail = "<p>And it ends.</p>"
    with_it, without = (H.main_text(H.blocks(page.format(a=BODY, x=x, b=tail)), np.zeros(1000, bool)) for x in (piece, ""))
    assert with_it == without and without.endswith("And it ends.")


def test_a_name_that_holds_most_of_the_text_is_only_a_hint():
    none = np.zeros(1000, bool)
    wrapped = f'<body><div class="content-with-comments">{BODY}<div class="ad-slot">buy</div><ul class="comment-list"><li>nice</li></ul></div></body>'
    assert H.main_text(H.blocks(wrapped), none) == H.main_text(H.blocks(f"<body><div>{BODY}</div></body>"), none)
    assert H.main_text(H.blocks(f'<article><div class="entry-header"><h1>Head</h1></div>{BODY}<p class="social-policy">on policy</p></article>'), none).startswith("Head")
    assert H.blocks('<article class="no-comments"><p>x</p></article>') == [("x", H.KEPT)]


def test_deep_markup_takes_linear_time():
    def seconds(n):
        page = "<div>" * n + "</p>" * n + '<div class="x-ad">' * n + "text" + "</span>" * n
        start = time.process_time()
        H.blocks(page)
        return time.process_time() - start

    seconds(1000)
    assert seconds(32_000) < 8 * seconds(8_000) + 0.2


def test_groups_are_cut_by_bytes_too(spark, monkeypatch):
    monkeypatch.setattr(H, "BYTES_PER_GROUP", 20_000)
    notice = "this site will be closed for work on sunday night"
    rows = [(i, "http://a.x/1", f"<body><div>{notice}</div><p>{' '.join(f'p{i}w{j}' for j in range(500))}</p></body>") for i in range(40)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    groups = frame.groupBy("url").agg(H._groups(256).alias("n")).first().n
    assert groups == -(-sum(len(h.encode()) for *_, h in rows) // 20_000) > 5
    assert all(r.text == " ".join(f"p{r.page_id}w{j}" for j in range(500)) for r in H.extract(frame).collect())


def test_very_long_pages(spark):
    words = " ".join(f"w{i}" for i in range(200_000))
    page = f"<body><nav><a>menu</a></nav><article><p>{words}</p></article>" + "<p>" * 50_000 + "</body>"
    (row,) = H.extract(spark.createDataFrame([(1, None, page)], "page_id long, url string, html string")).collect()
    assert row.text == words and not re.search("menu", row.text)
