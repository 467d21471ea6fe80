import html
import itertools
import random
import re

import pytest

from cairn.llm import html_template as ht
from cairn.llm.html_template import main_text

SHELL = '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- ad --><div class="ad">buy {n}</div><article>{body}</article><footer>&copy; foot {n}</footer>{end}'
SCHEMA = "page_id long, url string, html string"


def page(n, body, end="</body></html>"):
    return SHELL.format(n=n, body=body, end=end)


def brute(source):
    """Article of these shells, by plain patterns."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|div)[^>]*>", inner)
    lines = (" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "<br" in b else "", b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def texts(spark, sources, url="http://one.example.org/x"):
    rows = [(i, url, s) for i, s in enumerate(sources)]
    return {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_pages_of_one_shape(spark):
    rng = random.Random(1)
    words = ["alpha", "beta&amp;", "g&auml;mma", "d<b>el</b>ta", "&lt;x&gt;", "e  \n f"]
    rows = []
    for i in range(60):
        body = f"<h1>Title {i}</h1><p><b>Lead {i}.<br><p>" + "</p><p>".join(" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(rng.randrange(1, 6))) + "</p>"
        rows.append((i, f"http://h{i % 3}.example.com/{i}", page(i, body, "" if i % 5 == 0 else "</body></html>"), "clash"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    assert {(r.host, r.n_pages >= 3) for r in ht.learn_templates(pages).collect()} == {(f"h{k}.example.com", True) for k in range(3)}
    got = main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == {r[0]: brute(r[2]) for r in rows}
    assert all(r.n_chars == len(r.text) for r in got)


def test_random_layouts_without_telling_names(spark):
    """Hosts of random nested boxes with menus, fixed paragraphs and articles, against what was put in."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 9)))
    said = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for h in range(8):
        names = [f"x{word()}" for _ in range(6)]
        fixed = [said(6) for _ in range(4)]
        menu = "".join(f'<li><a href="/{k}">{said(2)}</a></li>' for k in range(5))
        for n in range(9):
            i = 100 * h + n
            article = [f"{said(rng.randrange(20, 60))} {i} {k}" for k in range(rng.randrange(2, 6))]
            body = "".join(f"<p>{x}</p>" for x in article[1:])
            lead = f'<div class="{names[3]}">{article[0]}</div>'
            story = f'<div class="{names[4]}">{body}<p>{fixed[2]}</p></div>'
            rows.append((i, f"https://h{h}.example.net/{i}", f'<body><div class="{names[0]}">{fixed[0]}</div><ul class="{names[1]}">{menu}</ul><p>{fixed[1]}</p><div class="{names[2]}">{lead}{story}</div><p class="{names[5]}">{fixed[3]}</p></body>'))
            want[i] = "\n".join(article)
    got = main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.page_id: r.text for r in got} == want


def test_headers_and_footers(spark):
    got = texts(spark, [f'<body><header><p>Site name {i % 2}</p></header><p>{"words go on " * 9}{i}</p><p>Join our mailing list today and save.</p><p class="legal">Copyright Acme</p></body>' for i in range(10)])
    assert got == {i: "words go on " * 9 + str(i) for i in range(10)}


def test_copies_keep_their_articles(spark):
    same = [f"<body><nav>menu {i}</nav><div><p>{'the same story ' * 20}</p><p>and its end</p></div></body>" for i in range(6)]
    assert set(texts(spark, same).values()) == {("the same story " * 20).strip() + "\nand its end"}
    assert set(texts(spark, same[:1] * 6).values()) == {("the same story " * 20).strip() + "\nand its end"}
    # copies are no evidence: there are two distinct pages
    two = [f"<body><p>{'a story ' * 20}{i % 2}</p><p>fixed</p></body>" for i in range(6)]
    assert all(t.endswith("\nfixed") for t in texts(spark, two).values())


def test_vectors_decide(spark):
    """A text that all pages have, but not equally often as its surroundings, is data."""
    sources = [f"<body><div><p>{'story ' * 30}{i}</p>{'<p>Ha.</p>' * (1 + i % 3)}<p>Read more</p></div></body>" for i in range(9)]
    assert all(t == "story " * 30 + str(i) + "\nHa." * (1 + i % 3) for i, t in texts(spark, sources).items())
    counts = [ht.token_counts(*ht.parse(s)) for s in sources]
    common = set.intersection(*map(set, counts))
    fresh = itertools.count()
    by = lambda vector: ht.deduce([(k, r, vector([c[k, r][0] for c in counts]), sum(c[k, r][1] for c in counts), 0) for k, r in sorted(common)], 3)
    assert [len(by(f).texts) for f in (lambda v: hash(tuple(v)), lambda v: 0, lambda v: next(fresh))] == [1, 2, 0]


def test_two_layouts_of_a_host(spark):
    first = [f"<body><div class='a'>Shop</div><p>{'one ' * 30}{i}</p><p>Bye</p></body>" for i in range(30)]
    second = [f"<body><table><tr><td>Forum rules</td></tr></table><section><p>{'two ' * 30}{i}</p></section></body>" for i in range(5)]
    got = texts(spark, first + second)
    assert got == {i: ("one " * 30 if i < 30 else "two " * 30) + str(i if i < 30 else i - 30) for i in range(35)}


def test_slots_without_telling_names(spark):
    def shape(i):
        return f'<body><div class="top"><a href="/">home</a></div><div class="wrap x{i}"><div class="c1"><p>{"story words go on " * 20}{i}</p><form>name</form><div class="comments"><p>reader {i}</p></div></div><div class="sidebar">side</div></div></body>'

    for i, text in texts(spark, [shape(i) for i in range(8)]).items():
        assert text == ("story words go on " * 20 + str(i)).strip()


def test_odd_pages(spark):
    rows = [
        (1, None, None), (2, "http://x.example.com", ""), (3, "http://y.example.com", "plain text &amp; more"), (4, "http://z.example.com", "<article>one<p>two</article>"),
        (4, "http://z.example.com", "<article>one<p>two</article>"), (None, "http://z.example.com", "<article><header><h1>H</h1></header>x<aside>no</aside>y<script>bad()</script></article>"),
        (6, "http://q.example.com", "<article>" + "<p>long one</p>" * 20_000 + "</article>"), (7, "http://q.example.com", "<div>a < b <p class='x>y'>c</p></div></span></div>"),
    ]
    got = main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 8 and text[1] == "" and text[2] == "" and text[3] == "plain text & more" and text[4] == "one\ntwo"
    assert text[None].split() == ["H", "x", "y"] and text[6].count("\n") == 19_999 and text[7] == "a < b\nc"
    assert main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_template_tables_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(ht, "MAX_BROADCAST_TOKENS", 0)
    sources = [f"<body><p>{'word ' * 30}{i}</p><p>fixed</p></body>" for i in range(20)]
    assert texts(spark, sources) == {i: "word " * 30 + str(i) for i in range(20)}


@pytest.mark.parametrize(("name", "noise"), [("div related-work", False), ("div post-header", False), ("div #comments", True), ("section comment-list", True), ("div site-header", True), ("div cookie-notice", True), ("div story", False), ("header", True)])
def test_names(name, noise):
    assert ht.is_noise(name) == noise


def test_comment_and_notice_inside_the_article():
    source = '<article><p>Text</p><div class="cookie-notice">ok?</div><section id="comments"><p>first!</p></section><p>End&nbsp; here</p></article>'
    tags, blocks = ht.parse(source)
    assert ht.extract(tags, blocks, ht.deduce([], 0)) == "Text\nEnd here"
