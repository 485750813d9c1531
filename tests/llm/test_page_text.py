import html as entities
import random
import re

import pytest

from disarm.llm.html_tree import TEXT, Node, parse
from disarm.llm.page_text import extract_text, induce_wrappers, main_blocks
from disarm.llm.wrappers import _pairs, _weight, dump, fold, load, merge
from disarm.llm.url_filter import url_host
from pyspark.sql import functions as F
from tests.conftest import SF


def wrapped(pages):
    wrapper = None
    for page in pages:
        folded = fold(parse(page))
        wrapper = folded if wrapper is None else merge(wrapper, folded)
    return wrapper


def text(page, *others):
    return "\n".join(main_blocks(page, load(dump(wrapped([page, *others])))))


def plain(page):
    """Headings and paragraphs of the article element, for the layout of the given pages."""
    body = re.search(r"(?s)<article>(.*?)(?:</article>|$)", page or "")
    parts = re.split(r"</?(?:p|h1)>", body[1]) if body else []
    blocks = (" ".join(entities.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts)
    return "\n".join(b for b in blocks if b)


def test_given_pages_equal_a_plain_reading(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(90001, None, None), (90002, "", ""), (None, "no scheme", "<p>Hi &amp; bye</p>"), (90003, "http://solo.example/", "x < y <b>z</b>")], "page_id long, url string, html string")
    got = extract_text(pages.unionByName(odd).unionByName(pages.limit(3)).withColumn("text", F.lit(1)).withColumn("host", F.lit(2)).withColumn("_host", F.lit(3)))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(r.page_id, r.url, plain(r.html), len(plain(r.html))) for r in pages.collect() + pages.limit(3).collect()]
    want += [(90001, None, "", 0), (90002, "", "", 0), (None, "no scheme", "Hi & bye", 8), (90003, "http://solo.example/", "x < y z", 7)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert extract_text(pages.where("false")).collect() == []


SITE = """<html><head><title>T</title></head><body><div><b>Daily Bugle</b><br>since 1901</div>
<div><a href=/>Home</a> <a href=/n>{menu}</a> <a href=/s>Sport</a></div>
<div><h2>{title}</h2><p>{one}</p><p>{two} <i>and</i> more</div><div>We use cookies. <button>Accept</button></div>
<div>Printed in town. Reproduction needs leave.</div></body></html>"""


def site(i):
    return SITE.format(menu="News" + "!" * (i % 3), title=f"Title {i}", one=f"First words of {i} &mdash; here.", two=f"Second {i * 7}")


def test_constant_regions_without_names_are_template():
    pages = [site(i) for i in range(6)]
    assert text(*pages) == "Title 0\nFirst words of 0 — here.\nSecond 0 and more"
    alone = text(pages[0])  # nothing to compare with: only links and controls can be told
    assert "Daily Bugle since 1901" in alone and "Home" not in alone and "Accept" not in alone


def test_wrapper_decides_not_the_names():
    """With the texts of the constant regions made different on each page, they are slots and stay."""
    pages = [site(i).replace("since 1901", f"since {1901 + i}") for i in range(6)]
    assert text(*pages).startswith("Daily Bugle since 1901\nTitle 0")


def test_copies_are_not_template():
    page = "<nav><a href=/>x</a></nav><article><h1>Same</h1><section><p>Words all over.</p></section></article><footer>f{}</footer>"
    pages = [page.format(i) for i in range(9)]
    assert text(*pages) == "Same\nWords all over."
    assert text(pages[0], pages[0]) == "Same\nWords all over."


RICH = """<!doctype html><html><body class="has-sidebar comments-open"><header id=top><h1>Site</h1></header><nav><ul><li>Menu<ul><li>Sub</ul></ul></nav>
<div class="layout with-nav"><aside>Side</aside><main><div class="breadcrumbs">Home &gt; x</div><article class="post"><header><h1>A  title
of two lines</h1></header><p>One<br>line &copy; 2020 &lt;tag&gt;<p>Two<script>var a = "</p><p>no";</script> <span class="ad-label">Anzeige</span>words
<div class="share-box">Share this</div><ul><li>first<li>second <a href=u>link</a></ul><table><tr><td>c1<td>c2<tr><td>c3</table>
<blockquote>Quote</blockquote><form><label>Mail</label><input><button>Go</button></form><div style="display: none">secret</div><pre>a
 b</pre><footer>tags</footer></article><section id="comments"><h3>Comments</h3><article class="comment">First!</article></section></main></div>
<div class=cookie-notice>We use cookies</div><footer>Imprint</footer><!-- <p>no</p> --><noscript>Enable it</noscript></body></html>"""


def test_regions_by_name_and_role():
    want = "A title of two lines\nOne line © 2020 <tag>\nTwo words\nfirst\nsecond link\nc1\nc2\nc3\nQuote\na b"
    assert text(RICH) == want
    assert text(*[RICH.replace("second", f"second{i}") for i in (3, 4, 5)]) == want.replace("second", "second3")


@pytest.mark.parametrize("page, want", [
    ("<article><p>a<p>b</article>", "a\nb"), ("<p>a < b</p> c", "a < b\nc"), ("<article>cut &am", "cut &am"), ("<div>un<b>closed", "unclosed"),
    ("<article><p title='>'>q</p><p a=\"", "q"), ("<article>x<!-- never closed", "x"), ("<article>x<script>never closed", "x"), ("", ""), (None, ""),
    ("<nav>menu <article><p>in an unclosed menu, long enough</p></article>", "in an unclosed menu, long enough"), ("<p>&nbsp;a&#160; b&#x41;</p>", "a bA"),
    ("<form><h1>T</h1><p>all in a form</p></form>", "T\nall in a form"), ("<article>a<hr>b</article>c", "a\nb"), ("<footer>only</footer>", ""), ("<P CLASS=x>UP</P>", "UP"),
])
def test_odd_pages(page, want):
    assert "\n".join(main_blocks(page or "", None)) == want


def test_long_and_deep_pages_are_linear():
    for page in ("<div>" * 200_000 + "deep", "<a '" * 200_000, "<!" * 200_000, "<p>" * 200_000, "<b x=\"" * 100_001, "<li><ul>" * 100_000, "</div>" * 200_000, "&am" * 300_000):
        main_blocks(page, None)
    many = "<article>" + "".join(f"<div class=k{'ab'[i % 2]}>w{i}</div>" for i in range(4000)) + "</article>"
    assert text(many, many.replace("w7<", "other<")).count("\n") == 3999
    wide = [f"<div>{''.join(f'<div class={chr(97 + i)}{chr(97 + j)}{k}x>t{i * j}</div>' for j in range(26))}</div>" for i in range(26) for k in "uvw"]
    assert wrapped(wide).n == 78


def trees(rng, depth=0):
    node = Node(rng.choice("ab"))
    if depth < 3:
        node.kids = [trees(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return node


def best(a, b):
    """Simple tree matching by trying every ordered choice of children."""
    def lists(xs, ys):
        if not xs or not ys:
            return 0
        return max(lists(xs[1:], ys), lists(xs, ys[1:]), best(xs[0], ys[0]) + lists(xs[1:], ys[1:]))

    return 0 if a.label != b.label else 1 + lists(a.kids, b.kids)


def test_matching_is_the_best_one():
    rng = random.Random(11)
    for _ in range(300):
        a, b = trees(rng), trees(rng)
        labels = [k.label for k in a.kids], [k.label for k in b.kids]
        same = any([k.label for k in x.kids] == [k.label for k in y.kids] and len(x.kids) > 1 for x in nodes(a) for y in nodes(b))
        assert _weight(a, b, {}) == best(a, b) or same and _weight(a, b, {}) <= best(a, b), labels
        assert all(x.label == y.label for x, y in _pairs(a.kids, b.kids, {}))


def nodes(node):
    return [node, *[n for k in node.kids for n in nodes(k)]]


def test_wrappers_of_a_hot_host_in_many_parts(spark):
    rows = [(i, "http://hot.example/" if i % 3 else f"http://h{i % 7}.example/x", site(i)) for i in range(150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(20)
    found = {r.host: load(r.wrapper) for r in induce_wrappers(pages.select(url_host(F.col("url")).alias("_host"), F.col("html").alias("_html"))).collect()}
    assert found["hot.example"].n == 100 and sum(w.n for w in found.values()) == 150
    assert {r.page_id: r.text for r in extract_text(pages).collect()} == {i: f"Title {i}\nFirst words of {i} — here.\nSecond {i * 7} and more" for i in range(150)}
    assert all(n.label == TEXT or n.kids for n in nodes(found["hot.example"]))
