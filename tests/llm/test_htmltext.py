"""Main texts: the marked articles of the table, sites without marks, classes against plain vectors, parsing, edges."""

import html as html_lib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagemill.llm import htmltext, queries
from pagemill.llm.htmltree import Block, parse

from ..conftest import SF


def texts_of(html):
    return [t.text for t in parse(html) if isinstance(t, Block)]


@pytest.mark.parametrize(
    "html, blocks",
    [
        (None, []),
        ("", []),
        ("a < b and c > d", ["a < b and c > d"]),
        ("<div>x<p>y<p>z<ul><li>1<li>2</ul><table><tr><td>a<td>b<tr><td>c</table>", ["x", "y", "z", "1", "2", "a", "b", "c"]),
        ("<b>foo</b>bar<br>z &am<i>p;</i> &nbsp;&lt;&#x41;&eacute;", ["foobar z &amp; <Aé"]),
        ('<script>var t="</p><p>no";</script><style>p{}</style><p title="a>b">yes<!-- <p>no --><p', ["yes"]),
        ("<head><title>no</title><p>yes", ["yes"]),
        ("<p>one</div></p></b>two", ["one", "two"]),
        ("<select><option>no</select><noscript>no</noscript><p>yes<button>no</button></p>", ["yes"]),
    ],
)
def test_blocks(html, blocks):
    assert texts_of(html) == blocks


def test_op11_takes_the_articles_of_the_table(spark):
    found = {r.page_id: r for r in queries.op11_templates(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(found) == len(pages)
    for r in pages:
        inside = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = (" ".join(html_lib.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inside.replace("<b>", "").replace("<br>", " ")))
        text = "\n\n".join(x for x in parts if x)
        assert (found[r.page_id].url, found[r.page_id].text, found[r.page_id].n_chars) == (r.url, text, len(text))


def _prose(rng, n):
    return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))) for _ in range(n)).capitalize() + "."


def _site(layout, n=12, seed=1):
    """(url, html, expected) of a site whose elements have no telling names."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        body = [_prose(rng, rng.randint(25, 60)) for _ in range(rng.randint(2, 6))]
        heading = _prose(rng, 5)
        replies = [_prose(rng, 8) for _ in range(rng.randint(0, 3))]
        out.append((f"https://{layout}.example.org/{i}", LAYOUTS[layout](rng, heading, body, replies), [heading, *body]))
    return out


LINKS = "".join(f'<a href="/{w}">{w}</a> ' for w in ("start", "sport", "kultur", "wetter"))
LAYOUTS = {
    "boxes": lambda rng, h, b, r: f'<body><div class="x1">{LINKS}</div><div class="x2"><div class="x3"><h1>{h}</h1>{"".join(f"<p>{x}</p>" for x in b)}<p>All rights stay with us, write to the desk.</p></div><div class="x4">{"".join(f"<p>{x}</p>" for x in r)}</div></div><div class="x5">Made with love in a small town.</div></body>',
    "named": lambda rng, h, b, r: f'<body><header><h2>Site</h2></header><nav>{LINKS}</nav><main><div class="post"><h1>{h}</h1>{"".join(f"<p>{x}" for x in b)}</div><section id="comments">{"".join(f"<p>{x}</p>" for x in r)}</section><aside>{_prose(rng, 30)}</aside></main><div class="cookie-notice">We use cookies.</div><form><p>Your mail</p></form><footer>&copy; us</footer></body>',
    "form": lambda rng, h, b, r: f'<body><form action="/"><table><tr><td>{LINKS}</td><td><h1>{h}</h1>{"".join(f"<p>{x}</p>" for x in b)}</td></tr></table></form></body>',
}


def test_sites_without_marks(spark):
    rows = [x for layout in LAYOUTS for x in _site(layout)]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string").repartition(4)
    found = {r.page_id: r.text.split("\n\n") for r in htmltext.main_texts(pages).collect()}
    assert [found[i] for i in range(len(rows))] == [x for _, _, x in rows]


def test_both_ways_to_the_host_table_agree(spark):
    rows = [x for layout in LAYOUTS for x in _site(layout, seed=2)]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    assert sorted(map(tuple, htmltext.main_texts(pages, broadcast_bytes=0).collect())) == sorted(map(tuple, htmltext.main_texts(pages).collect()))


def test_classes_against_plain_vectors(spark):
    rows = [(i, u, h) for i, (u, h, _) in enumerate(_site("boxes") + _site("form"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", htmltext.host_of(F.col("url"))).withColumn("row", F.xxhash64("page_id", "html"))
    found = htmltext.equivalence_classes(htmltext.occurrence_vectors(pages).cache(), 4, 0.5, 2).collect()
    vectors = defaultdict(dict)
    for i, u, h in rows:
        for t in parse(h):
            key = (u.split("/")[2], htmltext._signed(t.code))
            vectors[key][i] = vectors[key].get(i, 0) + 1
    groups = defaultdict(set)
    for (host, token), v in vectors.items():
        if len(v) >= 6:
            groups[host, tuple(sorted(v.items()))].add(token)
    expected = {(host, frozenset(tokens)) for (host, _), tokens in groups.items() if len(tokens) >= 2}
    got = defaultdict(set)
    for r in found:
        got[r.host, r["class"]].add(r.token)
    assert {(host, frozenset(tokens)) for (host, _), tokens in got.items()} == expected


def test_tokens_out_of_order_leave_the_template(spark):
    """Two boxes that change places stay data, the fixed notice beside the articles goes."""
    rng = random.Random(4)
    pages, expected = [], []
    for i in range(10):
        body = [_prose(rng, 40), _prose(rng, 30)]
        pair = ["<p>Left box of us</p>", "<p>Right box of us</p>"]
        pages.append((i, "http://h.example/x", f"<body><div><h1>News</h1>{''.join(pair[:: 1 if i % 2 else -1])}{''.join(f'<p>{x}</p>' for x in body)}<p>Mail us today</p></div></body>"))
        expected.append([*[re.sub("<.*?>", "", x) for x in pair[:: 1 if i % 2 else -1]], *body])
    found = {r.page_id: r.text.split("\n\n") for r in htmltext.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [found[i] for i in range(10)] == expected


def test_copies_keep_their_article(spark):
    page = "<html><body><nav><a href=/>home</a></nav><article><h1>Title</h1><p>The same story again.</p></article></body></html>"
    pages = spark.createDataFrame([(i, "https://copy.example/a", page, 1) for i in range(30)], "page_id long, url string, html string, text int")
    assert {r.text for r in htmltext.main_texts(pages).collect()} == {"Title\n\nThe same story again."}


def test_edges(spark):
    page = "<article><p>Some text.</p></article>"
    rows = [(1, None, page), (2, "not a url", page), (3, "https://U@Host.example:80/x", page), (3, "https://U@Host.example:80/x", page), (None, "http://host.example", None), (4, "http://host.example", ""), (5, "http://host.example", "<nav>only <a href=/>links</a></nav>"), (6, "http://host.example", "<p>" + "word " * 1_000_000)]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, host int, tokens int").repartition(3)
    found = sorted(((r.page_id, r.text if r.n_chars < 100 else r.n_chars) for r in htmltext.main_texts(pages).collect()), key=str)
    assert found == sorted([(1, "Some text."), (2, "Some text."), (3, "Some text."), (3, "Some text."), (None, ""), (4, ""), (5, ""), (6, 4_999_999)], key=str)
    assert htmltext.main_texts(pages.where(F.lit(False))).count() == 0
    assert [r.h for r in pages.select(htmltext.host_of(F.col("url")).alias("h")).distinct().collect() if r.h] .count("host.example") == 1
