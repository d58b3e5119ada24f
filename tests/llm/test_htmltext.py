from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import pytest

from agreemill.llm import htmltext

ARTICLE = "<h1>Title</h1><p>First, with <b>bold</b> and a <a href=x>link</a>, here.</p><p>Second &amp; last.</p>"
EXPECTED = "Title\n\nFirst, with bold and a link, here.\n\nSecond & last."


@pytest.mark.parametrize(
    "html, expected",
    [
        (f"<html><body><nav><ul><li><a>Home</a></ul></nav><article>{ARTICLE}</article><footer>f</footer></body></html>", EXPECTED),
        (f"<body class='has-sidebar'><div id=content>{ARTICLE}</div><div class='sidebar-left'><p>Side, side, side, side.</p></div>", EXPECTED),
        (f"<header><a>Site</a></header><main><header><h1>Title</h1></header>{ARTICLE[14:]}</main>", EXPECTED),
        (f"<div class='page-with-sidebar'><article>{ARTICLE}</article><aside>x, y, z</aside></div>", EXPECTED),
        (f"<article>{ARTICLE}<section id='comments'><article class=comment><p>Nice, very, very nice.</p></article></section></article>", EXPECTED),
        (f"<article>{ARTICLE}<form><p>Name, mail</p><input></form><div role=alert>Notice, this</div><div hidden>no</div></article>", EXPECTED),
        (f"<article>{ARTICLE}<script>if (a < b) document.write('<p>x</p>')</script><style>p{{}}</style><!-- <p>c</p> --></article>", EXPECTED),
        (f"<article>{ARTICLE}<div class='ad'>Buy, buy</div><div class=cookieNotice>We, us</div></article>", EXPECTED),
        (f"<div id=header><p>My site, yes</p></div><div class=elementor-widget><div class='entry-header'><h1>Title</h1></div>{ARTICLE[14:]}</div>", EXPECTED),
        ("<p>One<p>Two<br>three<p>  Four\n\tfive ", "One\n\nTwo three\n\nFour five"),
        ("<ul><li>a<li>b</ul>", "a\n\nb"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
        ("plain &lt;text&gt; &#233;&eacute;&#x1F600; &nope; &amp", "plain <text> éé😀 &nope; &"),
        ("<p>a <script>x</script>b<button>no</button> c</p>", "a b c"),
        ('<a title="a > b" href=\'x>y\'>link</a> text enough, really', "link text enough, really"),
        ("<div><p>x</p></div></p></div></b>tail, tail", "x\n\ntail, tail"),
        ("<title>t</title>", ""),
        ("<p>İ<SCRIPT>x</Script>y<textarea>z</TEXTAREA></p>", "İy"),
        ("<nav>only</nav>", ""),
        ("", ""),
        (None, ""),
        ("a < b and <3", "a < b and <3"),
        ("<p>x<!-- open", "x"),
        ("AT&am<b>p;</b> hello, you", "AT&amp; hello, you"),
        ("<p>a &amp;lt; b &#x26;gt;</p>", "a &lt; b &gt;"),
        ("<p data-hidden>shown, yes</p><p class='x' hidden>no, no</p><p hidden=''>no</p>", "shown, yes"),
        ("<p title='a' class=note hidden = x>no</p><p>yes, sir</p>", "yes, sir"),
        ("<p>x <script>a</scripty>b</script> y</p>", "x y"),
    ],
)
def test_main_text(html, expected):
    assert htmltext.main_text(html) == expected


def test_two_wrapped_paragraphs_are_kept():
    html = "<div id=w><div><p>Alpha, beta, gamma.</p></div><div><p>Delta, epsilon, zeta, eta.</p></div></div><div><a>More</a> <a>links</a></div>"
    assert htmltext.main_text(html) == "Alpha, beta, gamma.\n\nDelta, epsilon, zeta, eta."


def words(n, commas=0):
    return "word, " * commas + "more " * (n - commas - 1) + "end."


def test_sectioned_article_is_kept_whole():
    long = "".join(f"<p>{words(60, 15)}</p>" for _ in range(10))
    html = f"<body><nav><a>x</a></nav><article><header><h1>Head</h1></header><section><h2>One</h2><p>{words(16)}</p></section><section>{long}</section><div><ul><li><a>Top</a></li><li><a>Next page</a></li></ul></div><p>Last.</p></article><div>Out, side.</div></body>"
    got = htmltext.main_text(html).split("\n\n")
    assert got == ["Head", "One", words(16), *[words(60, 15)] * 10, "Last."]
    main = html.replace("article>", "main>")
    assert htmltext.main_text(main).split("\n\n") == got


def test_sections_without_an_article_element():
    long = "".join(f"<p>{words(60, 15)}</p>" for _ in range(8))
    html = f"<body><div class=side><h3>Links</h3><p><a>one</a> <a>two</a></p></div><div id=c><div class=s1><h2>Intro</h2><p>Short intro, here.</p></div><div class=s2>{long}</div><div class=s3><h2>End</h2><p>So it ends.</p></div><div><a>Next</a></div></div></body>"
    assert htmltext.main_text(html).split("\n\n") == ["Intro", "Short intro, here.", *[words(60, 15)] * 8, "End", "So it ends."]


def test_widget_names_do_not_drop_running_text():
    body = "".join(f"<p>{words(60, 15)}</p>" for _ in range(3))
    price = "The share price rose by three percent, after the company had published its results."
    html = f"<article><h1>Head</h1>{body}<div class=share-price><p>{price}</p></div><div class=share><p>Share this <a>here</a>, or <a>there</a>, and tell all of your friends about it today or tomorrow.</p></div><div class=social>Follow us</div><div class=comments><p>{words(60, 15)}</p></div><div class='notice share'><p>{price}</p></div></article><div class=menu><p>{price}</p></div>"
    assert htmltext.main_text(html).split("\n\n") == ["Head", *[words(60, 15)] * 3, price]


HOSTILE = {
    "quotes": '<a "' * 200_000,
    "depth": "<div>" * 100_000 + "x",
    "open values": '<a title="' * 100_000,
    "angles": "<" * 300_000,
    "comments": "<!--" * 100_000,
    "stray ends": "<b>" * 100_000 + "</i>" * 100_000,
    "inline": "<i>" + "<div>" + "<b>" * 100_000 + "</i>" * 100_000,
    "scripts": "<script>" * 50_000,
    "paragraphs": "<p>x" * 100_000,
    "long name": f"<p {'a' * 1_000_000}>x",
    "many attributes": "<p " + 'a="b" ' * 200_000 + ">x",
    "blanks": f"<p a{' ' * 1_000_000}>x",
    "equals": f"<p {'=' * 1_000_000}>x",
    "list in list": "<ul><li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000,
    "texts in inline": "<b>" * 50_000 + "x<p></p>" * 50_000,
    "articles": "<article class=comment>" * 50_000 + "x",
    "references": "&amp" * 200_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    start = time.time()
    htmltext.main_text(HOSTILE[name])
    assert time.time() - start < 5


def test_nothing_is_capped():
    assert htmltext.main_text("<p>x" * 20_000).count("x") == 20_000


class Slow(HTMLParser):
    """Tree and scores by recursion over well-formed pages of div, section, p and a."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.now = {"tag": "#root", "kids": [], "up": None}
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.now = {"tag": tag, "kids": [], "up": self.now, "drop": tag == "nav" or ("class", "ad") in attrs}
        self.now["up"]["kids"].append(self.now)

    def handle_endtag(self, tag):
        self.now = self.now["up"]

    def handle_data(self, data):
        self.now["kids"].append(data)

    def blocks(self, node=None):
        """(leaf element, text, linked characters) in page order."""
        node = node or self.root
        for kid in node["kids"]:
            if isinstance(kid, str) or kid.get("drop"):
                continue
            if kid["tag"] == "p":
                texts = [(x, 0) if isinstance(x, str) else ("".join(x["kids"]), len("".join(x["kids"]))) for x in kid["kids"]]
                yield kid, " ".join("".join(x for x, _ in texts).split()), sum(n for _, n in texts)
            else:
                yield from self.blocks(kid)

    def main(self):
        found = list(self.blocks())
        nodes = [self.root]
        for node in nodes:
            nodes += [k for k in node["kids"] if not isinstance(k, str) and k["tag"] != "a" and not k.get("drop")]

        def within(node, leaf):
            while leaf is not None and leaf is not node:
                leaf = leaf["up"]
            return leaf is node

        def score(node):
            total = 0.0
            for leaf, text, links in found:
                up, share = leaf["up"], iter((1, 1 / 2, 1 / 6, 1 / 9, 1 / 12))
                for part in share:
                    if up is node:
                        total += (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links / len(text)) * part
                    up = up["up"] if up else None
            own = [(len(t), n) for leaf, t, n in found if within(node, leaf)]
            return total * (1 - sum(n for _, n in own) / max(1, sum(s for s, _ in own)))

        scores = {id(n): score(n) for n in nodes}
        order = []

        def visit(node):
            order.append(node)
            for kid in node["kids"]:
                if not isinstance(kid, str) and kid["tag"] != "a" and not kid.get("drop"):
                    visit(kid)

        visit(self.root)
        best = max(order, key=lambda n: scores[id(n)])
        kept = [n for n in order if n is best]
        for n in order:
            if n is not best and n["up"] is best["up"] and n is not self.root:
                own = [(len(t), k) for leaf, t, k in found if within(n, leaf)]
                density = sum(k for _, k in own) / sum(s for s, _ in own) if own else 0.0
                if (n["tag"] == "p" and density < 0.25) or scores[id(n)] > 0.2 * scores[id(best)]:
                    kept.append(n)
        return "\n\n".join(t for leaf, t, _ in found if any(within(n, leaf) for n in kept))


def test_scores_equal_a_slow_extractor():
    rng = random.Random(11)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            text = words(rng.randint(8, 90), rng.randint(0, 6))
            link = f"<a>{words(rng.randint(3, 30))}</a>" if rng.random() < 0.4 else ""
            return f"<p>{text if rng.random() < 0.8 else ''}{link or 'x'}</p>"
        name = rng.choice(["div", "section", "div class='ad'", "nav"] if depth < 4 else ["div"])
        return f"<{name}>{''.join(tree(depth - 1) for _ in range(rng.randint(1, 4)))}</{name.split()[0]}>"

    for _ in range(300):
        html = tree(4)
        assert htmltext.main_text(html) == Slow(html).main(), html


def test_query(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "old"), (2, None, None, None), (1, "u", f"<article>{ARTICLE}</article>", "old")]
    got = [tuple(r) for r in htmltext.page_texts(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=str) == sorted([(1, "u", EXPECTED, len(EXPECTED)), (2, None, "", 0), (1, "u", EXPECTED, len(EXPECTED))], key=str)
    assert htmltext.page_texts(spark.createDataFrame([], schema)).collect() == []
