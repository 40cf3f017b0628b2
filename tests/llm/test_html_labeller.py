import html
import re

import numpy as np

from fenestra.llm import html_labeller as h
from fenestra.llm.queries import all_queries


def article_text(page):
    """Main text of the layout in the given pages, by plain pattern matching."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<b>", "").replace("<br>", " ")
    parts = (" ".join(html.unescape(p).split()) for p in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(p for p in parts if p)


def test_all_given_pages(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = all_queries()["op2_html_labeller"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.text, r.url) == (article_text(pages[r.page_id].html), pages[r.page_id].url)
        assert r.n_chars == len(r.text)


def test_held_out_layouts():
    rng, vectors = np.random.default_rng(99), h.Vectors()
    right = total = 0
    for _ in range(150):
        page, labels = h._written_page(rng)
        found = h.blocks(page)
        if len(found) == len(labels):
            right += (h.label(h.trained(), [found], vectors)[0] == np.array(labels)).sum()
            total += len(labels)
    assert total > 3_000 and right / total > 0.985


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    w = h._initial(rng)
    x, mask = rng.normal(size=(2, 4, h.INPUTS)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], float)
    y = rng.integers(0, 2, (2, 4)).astype(float)

    def loss():
        z = h.scores(w, x, mask)
        return (mask * (np.logaddexp(0, z) - y * z)).sum() / mask.sum()

    grads = h._gradients(w, x, mask, y)
    for name in w:
        flat, at = w[name].reshape(-1), int(rng.integers(w[name].size))
        kept = flat[at]
        flat[at] = kept + 1e-5
        up = loss()
        flat[at] = kept - 1e-5
        down = loss()
        flat[at] = kept
        assert abs((up - down) / 2e-5 - grads[name].reshape(-1)[at]) < 1e-6


def test_blocks_of_broken_markup():
    page = ('<!DOCTYPE html><head><title>no</title><script>var t="</p>";</script><body><div class="a b">one&nbsp;&amp;<b>two<br>three'
            '<p>four<p>five &lt;x&gt;<!-- gone > --><style>p{}</style></div><td>six 1 < 2 <a href="x>y">link</a>')
    found = h.blocks(page)
    assert [b[1] for b in found] == ["one &two three", "four", "five <x>", "six 1 < 2 link"]
    assert found[0][0][:4] == ("body", "div", ".a", ".b") and found[3][2] == 4


def test_an_open_head_ends():
    texts = lambda page: [b[1] for b in h.blocks(page)]
    assert texts("<html><head><title>no</title><meta x><div><p>one</p><p>two</div>") == ["one", "two"]
    assert texts("<head><title>no</title><script>x</script> text <b>more</b><p>next") == ["text more", "next"]
    assert texts("<head><noscript><p>no</p></noscript><template><p>no</p></template></head><p>yes") == ["yes"]
    assert texts("<p>sum <math><mi>a</mi><mo>+</mo><mn>1</mn></math> is") == ["sum a+1 is"]


def test_awkward_pages(spark):
    long = "<article>" + "<p>" + "many words here. " * 40_000 + "</p></article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "just text, no tags", None), (4, "u", long, "x"), (4, "u", long, "x"),
            (5, "u", "<p", "x"), (6, "u", "<script>only()", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = h.main_text(pages, ["page_id", "url", "text"]).collect()
    assert len(got) == 7 and got[0].text == got[1].text == got[6].text == ""
    assert [r.n_chars for r in got if r.page_id == 4] == [len("many words here. " * 40_000) - 1] * 2
    assert h.main_text(pages.limit(0), ["page_id"]).count() == 0
