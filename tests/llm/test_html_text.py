"""Main text of pages against expected texts, a plain parser, and its edge cases."""

import time
from html.parser import HTMLParser

import pytest

from verdigris.llm import html_text, queries

P = "This is a long paragraph of the story, with many words in it and a full stop. " * 4
Q = P.strip()
SF = "/root/testdata/sf0.001"

CASES = {
    "one form around the page": (f"<body><form action=x><div><h2>Title</h2><p>{P}</p><p>{P}</p><label>Name</label><input><select><option>a</select><button>Go</button></div></form></body>", f"Title\n{Q}\n{Q}"),
    "a form in the article": (f"<body><div><h2>Title</h2><p>{P}</p><p>{P}</p><form><label>Name</label><input><p>Send us mail</p></form></div></body>", f"Title\n{Q}\n{Q}"),
    "no article tag": (f"<body><div class=top><a href=1>Home</a> <a href=2>News</a></div><div><h1>Head</h1><div><p>{P}</p><p>{P}<a href=x>link</a></p><p>Short.</p></div></div><div>Some contact text</div></body>", f"Head\n{Q}\n{Q} link\nShort."),
    "two articles": (f"<body><main><article><h1>One</h1><p>{P}</p><p>{P}</p></article><article><h2>Two</h2><p>{P}</p></article></main><div><a href=x>all of these are links</a></div></body>", f"One\n{Q}\n{Q}\nTwo\n{Q}"),
    "a misplaced article": (f"<body><article><p>Teaser</p></article><div><h1>Real</h1><p>{P}</p><p>{P}</p><p>{P}</p></div></body>", f"Real\n{Q}\n{Q}\n{Q}"),
    "comments longer than the article": (f"<body><main><h1>T</h1><div class=byline>By A</div><div><p>{P}</p><p>{P}</p></div><div class=comments><p>{P}</p><p>{P}</p><p>{P}</p></div></main></body>", f"T\nBy A\n{Q}\n{Q}"),
    "menus, notices and adverts": (f"<body><header>Site</header><nav><ul><li><a href=x>a</a></ul></nav><div id=cookie-notice>We use {P}</div><div class='x ad'>{P}</div><article><header><h1>T</h1></header><p>{P}</p><p>{P}</p></article><aside>{P}</aside><footer>{P}</footer></body>", f"T\n{Q}\n{Q}"),
    "references and white space": ("<p>a &amp; b&nbsp;&nbsp;c\n\t d &lt;x&gt; &#233;&#x41;</p>", "a & b c d <x> éA"),
    "scripts, styles and comments": (f"<style>p{{}}</style><script>var t='</p>';</script><p>{P}<!-- no --></p><p>{P}</p>", f"{Q}\n{Q}"),
    "a line of a table each cell": (f"<article><p>{P}</p><table><tr><td>a<td>b<tr><td>c</table></article>", f"{Q}\na\nb\nc"),
    "text without tags": ("just &lt; text", "just < text"),
    "open at the end": (f"<div><p>{P}<p>{P}<b>more<div", f"{Q}\n{Q} more"),
    "nothing but a script": ("<script>x</script>", ""),
    "a share of the market": (f"<body><div class=nav><a href=x>a</a></div><div class=share-of-market><h2>T</h2><p>{P}</p><p>{P}</p></div></body>", f"T\n{Q}\n{Q}"),
    "a policy on comments": (f"<body><h1>T</h1><div><p>{P}</p><div id=comment-policy><p>{P}</p></div><section class=related-work><p>{P}</p></section></div><ul class=share-buttons><li>{P}</ul></body>", f"T\n{Q}\n{Q}\n{Q}"),
    "a board of notices": (f"<body><div class=notice-board><p>{P}</p><p>{P}</p></div><div class=cookie-notice>{P}</div></body>", f"{Q}\n{Q}"),
    "an article under a wrong name": (f"<body><div class=sidebar><h2>T</h2><p>{P}</p><p>{P}</p></div><div>by me</div></body>", f"T\n{Q}\n{Q}"),
    "nothing but a menu": (f"<body><div class=menu><a href=x>{P}</a><a href=y>{P}</a></div></body>", ""),
    "nothing but a notice": ("<body><div class=cookie-notice>We use cookies on this site.</div></body>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    page, text = CASES[name]
    assert html_text.main_text(page) == text


class Plain(HTMLParser):
    """The blocks of article elements, with nothing else in mind."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        if tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_query_against_a_plain_parser(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op1_html_text(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        plain = Plain()
        plain.feed(r["html"] or "")
        plain.close()
        text = "\n".join(t for b in plain.blocks if (t := " ".join(b.split())))
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (text, len(text), r["url"])


def test_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", None, "x", "y"), (2, None, "", "x", "y"), (None, "u", f"<p>{P}", "x", "y"), (3, "u", f"<p>{P}", "x", "y"), (3, "u", f"<p>{P}", "x", "y"), (4, "u", "<p>" + "long 😀 text. " * 200_000, "x", "y")]
    got = html_text.extract_text(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got.collect()) == [(0, len(Q)), (1, 0), (2, 0), (3, len(Q)), (3, len(Q)), (4, 13 * 200_000 - 1)]
    assert html_text.extract_text(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("page", ["<div>" * 8000 + "<p>text of it</p>" + "</div>" * 8000, "<li><div>" * 8000 + "<p>text of it", "</b>" * 20000 + "<p>text of it", "<p>text of it<b" + "<a>" * 20000])
def test_deep_pages_take_linear_time(page):
    began = time.time()
    assert "text of it" in html_text.main_text(page)
    assert time.time() - began < 5
