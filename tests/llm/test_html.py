import html
import itertools
import random
import re
import time
from math import exp

import pyarrow.parquet as pq
import pytest

from tidemark.llm import html_text


@pytest.fixture(scope="module")
def model():
    return html_text.default_model()


def truth(page):
    """The article element's blocks, read off the known template of the test pages."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1|article)>", inner)]
    return "\n".join(x for x in parts if x)


def test_test_pages_exactly(model):
    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        assert model.text(r["html"]) == truth(r["html"]), r["page_id"]


def test_held_out_labelled_pages(model):
    good = total = wrong = 0
    for page in html_text.labelled_pages(80, seed=99):
        nodes = html_text.parse(page)
        p = model.marginals(html_text.parse(re.sub(" data-main", "", page)))
        for n, x in zip(nodes, p):
            if n.tag == "#text":
                want = nodes[n.parent].label
                total += want
                good += want and x >= 0.5
                wrong += (not want) and x >= 0.5
    assert good / total > 0.9 and wrong / (good + wrong) < 0.05


def test_marginals_brute(model):
    """Sum-product equals the sum over all assignments."""
    nodes = html_text.parse('<body><nav><a href=x>Home</a></nav><article><p>Some text here.</p><p>No.</p></article></body>')
    n = len(nodes)
    weight = [0.0] * n
    whole = 0.0
    for states in itertools.product((0, 1), repeat=n - 1):
        s = (0, *states)
        w = 1.0
        for i in range(1, n):
            p = model.edge[html_text.kind(nodes[i]), s[nodes[i].parent]]
            w *= (p if s[i] else 1 - p) * (exp(html_text.SHARE.get(html_text.kind(nodes[i]), 1.0) * sum(model.node.get(x, 0.0) for x in html_text.looks(nodes[i]))) if s[i] else 1)
        whole += w
        for i in range(n):
            weight[i] += w * s[i]
    got = model.marginals(nodes)
    assert got[1:] == pytest.approx([x / whole for x in weight[1:]], abs=1e-9)


@pytest.mark.parametrize("page", ["", None, "plain", "<", "<p", "<p>a<p>b</div></p></p>", "&amp;&#x41;&bogus; <b>x", "<script>if(a<b){}</script>t", "<!-- open", "<div " * 50, "<article>" * 300 + "deep", "<style>p{}</style><article><p>A\xa0 b\n\tc</article>"])
def test_odd_pages(model, page):
    text = model.text(page)
    assert "\n\n" not in text and "<b>" not in text


@pytest.mark.parametrize(
    "inner, want",
    [
        ("<p>One.</p><svg/><p>Two is here.</p>", "One.\nTwo is here."),
        ("<p>One.</p><iframe src=x><p>Two is here.</p>", "One.\nTwo is here."),
        ("<p>One.</p><script>var a = '<b>'; <p>Two is here.</p>", "One.\nTwo is here."),
        ("<p>One is here.</p><div>Two</div>", "One is here.\nTwo"),
        ('<p>See this code:</p><div class="highlight"><pre>x = 1</pre></div><p>Done.</p>', "See this code:\nx = 1\nDone."),
        ("<section><h2>S</h2><div><p>Deep.</p></div></section><figure><figcaption>A cap.</figcaption></figure>", "S\nDeep.\nA cap."),
        ('<p>One</p><div class="comments-free zone"><p>This is body text.</p></div>', "One\nThis is body text."),
        ('<p>Body of the page.</p><section class="comments"><p>User says something here.</p></section>', "Body of the page."),
        ('<p>Body of the page.</p><div id="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with a word of this, it is long enough.</p></div></div>', "Body of the page."),
        ("<p>Body of the page.</p><form><p>Your name</p><input><button>Send</button></form>", "Body of the page."),
        ("<p>Body of the page.</p><button>Read more</button><select><option>One<option>Two</select>", "Body of the page."),
        ('<p>Text.</p><div class="ad">Buy now, this is a long advert of many words.</div><p>More.</p>', "Text.\nMore."),
    ],
)
def test_article_holds_all_of_its_text(model, inner, want):
    assert model.text(f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article>{inner}</article><footer>x</footer></body></html>") == want


def test_blocks_and_references():
    texts = [n.text for n in html_text.parse('<div>a <b>b</b>&amp;<br>c<p>d  e<p title="x>y">f</div><td>g<script>no</script>') if n.tag == "#text"]
    assert texts == ["a b& c", "d e", "f", "g"]


def test_table(spark):
    rows = [(1, "u", "<article><p>" + "Long text goes on. " * 20 + "</p></article><footer>x</footer>"), (2, None, None), (None, "v", ""), (1, "u", "<nav><ul><li><a>m</a></ul></nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS id", "2 AS n_chars")
    got = html_text.extract(df).collect()
    assert [len(r.text) for r in got] == [r.n_chars for r in got] and got[0].n_chars == 379 and [r.n_chars for r in got[1:]] == [0, 0, 0]
    assert html_text.extract(df.limit(0)).count() == 0


#: A second way to make pages: other names, other nesting, texts of real words.
WORDS = "the of a in to and it was for on with as by at from that this river council old bridge night water people engine paper garden seven north early between open report".split()


def second_generator(seed):
    """(page, main text): main text in a part of its own among menus, notices, side boxes, comments and forms."""
    rng = random.Random(seed)
    some = lambda a, b: " ".join(rng.choice(WORDS) for _ in range(rng.randint(a, b)))
    line = lambda: some(6, 40).capitalize() + "."
    want, main = [], ""
    for _ in range(rng.randint(2, 9)):
        t = line()
        want.append(t)
        main += rng.choice([f"<p>{t}</p>", f"<p>{t}</p>", f"<div><p>{t}</p></div>", f"<ul><li>{t}</li></ul>", f'<div class="ad-free"><p>{t}</p></div>', f"<p>{t}"])
    after = rng.choice(["", f'<section class="comments"><p>{line()}</p><p>{line()}</p></section>', f"<form><label>{some(1, 2)}</label><button>{some(1, 2)}</button></form>", f'<div class="comment-list"><div class="comment"><p>{line()}</p></div></div>'])
    menu = "".join(f"<li><a href=/{i}>{some(1, 2)}</a></li>" for i in range(rng.randint(3, 8)))
    box = rng.choice(["", f'<div class="sidebar"><h4>{some(1, 3)}</h4><ul>{menu}</ul></div>', f"<aside><p>{line()}</p></aside>", f'<div class="cookie-notice">{line()}</div>'])
    holder = rng.choice([("<main>", "</main>"), ("<article>", "</article>"), ('<div class="post"><div class="content">', "</div></div>"), ("<main><article>", "</article></main>")])
    return f"<html><body><header><h2>{some(1, 3)}</h2><nav><ul>{menu}</ul></nav></header>{box}{holder[0]}{main}{after}{holder[1]}<footer><p>&copy; {some(2, 6)}</p></footer></body></html>", "\n".join(want)


def test_pages_of_a_second_generator(model):
    lost = extra = total = 0
    for seed in range(150):
        page, want = second_generator(seed)
        got, want = model.text(page).split("\n"), want.split("\n")
        total += len(want)
        lost += sum(t not in got for t in want)
        extra += sum(t not in want for t in got if t)
    assert lost / total < 0.05 and extra / total < 0.05, (lost, extra, total)


@pytest.mark.parametrize("piece", ["<iframe src=x><p>hello there.</p>", "<svg><p>hello there.</p>", "<div></p>", "<h1></p>x", "<script ", "<!", "<div class='a", "<td>x", "<ul><li><h1>", "<a <a", "<title>x", "&amp", "<p>x</div>", '<script "<b> '])
def test_long_pages_take_linear_time(piece):
    times = []
    for n in (60_000, 600_000):
        page = piece * (n // len(piece))
        begun = time.process_time()
        html_text.parse(page)
        times.append(time.process_time() - begun)
    assert times[1] < 30 * times[0] + 2, times
