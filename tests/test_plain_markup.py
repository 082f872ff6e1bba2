"""Plain markup is read without HTMLParser, and all pages as HTMLParser reads them."""

import random

from threatloom.operators import html as H

PIECES = [
    "<p>", "</p>", "<div class=\"a  b\">", "<a href=\"/x\" class=\"\">", "</a>", "<br>", "</br>", "<br/>", "<script>", "</script>", "<style>", "<title>", "</title>",
    "<textarea>", "<!DOCTYPE html>", "<!doctype>", "<!-- c -->", "<!x>", "<?pi?>", "<![CDATA[d]]>", "&amp;", "&amp", "&nope;", "&#65;", "&#x41;", "&#x;", "&#65", "&#", "&",
    "<", ">", "\"", "'", "<P>", "<p >", "< p>", "</ p>", "</p x>", "<a href=\"a<b\">", "<a href=\"a&amp;b\">", "<a href='q'>", "<a href>", "<a href=\"", "<h1", "<template>",
    "text", " ", "\n", "é ", "a=\"b\"", "/", ";", "1", "<plaintext>", "<a class=\"x\" class=\"y\">",
]


def by_parser(page):
    reader = H._TreeReader()
    reader.feed(page)
    reader.finish()
    return reader.rows, reader.texts


def test_same_elements_as_the_parser():
    chance = random.Random(7)
    for _ in range(20_000):
        page = "".join(chance.choice(PIECES) for _ in range(chance.randint(0, 14)))
        assert H._read_page(page) == (*by_parser(page), None), page


def test_plain_page_needs_no_parser(monkeypatch):
    fed = []
    monkeypatch.setattr(H._TreeReader, "feed", lambda self, data: fed.append(data))
    page = '<!doctype html><html><body class="c"><p>a &amp; b &#33;<br>c</p></body></html>'
    rows, texts, error = H._read_page(page)
    assert (fed, [row[3] for row in rows], texts, error) == ([""], ["html", "body", "p", "br"], ["a & b !", "c"], None)
