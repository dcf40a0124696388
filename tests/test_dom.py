"""selectors, the largest block, nested and broken markup."""

import os
import re

import pytest

from quillwright import registry
from quillwright.functions.dom import SELECTORS, Tree, posting, posting_of
from quillwright.plans.adapters import Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("selector", SELECTORS)
def test_each_selector(selector):
    if selector[0] == "[":
        name, value = selector[1:-1].split("=")
        open_tag = f'<span {name.rstrip("*")}="{"x-" if name.endswith("*") else ""}{value[1:-1]}{" y" if name.endswith("*") else ""}">'
    else:
        open_tag = f'<span class="a {selector[1:]} b">' if selector[0] == "." else f'<span id="{selector[1:]}">' if selector[0] == "#" else f"<{selector}>"
    end = f"</{re.match('<(.*?)[ >]', open_tag)[1]}>"
    source, text = posting_of(f"<html><body><div>much longer text than the chosen one</div>{open_tag}one <b>two</b>\n three{end} four</body></html>")
    first = next(s for s in SELECTORS if s == selector or (s == ".description" and selector == ".description"))
    assert text == "one\ntwo\nthree" and SELECTORS.index(source) <= SELECTORS.index(first)


def test_broken_and_nested():
    assert posting_of("<div>ab<div>longest of all</div></div><div>x</div>") == ("largest", "ab\nlongest of all")  # the outer one has more
    assert posting_of("<div>one</b><p>two<p>three</div>four") == ("largest", "one\ntwo\nthree")  # stray end, open paragraphs
    assert posting_of("<body><nav>menu<div>in menu</div></nav>text <br>more<footer>f</footer>") == ("body", "text\nmore")  # not closed
    assert posting_of("<main><header>h</header>a &amp; b<script>if (a < b) '</div>'</script></main>") == ("main", "a & b")
    assert posting_of("<nav><main>never</main></nav><article>yes") == ("article", "yes")
    assert posting_of("<section/>x<div></div>") == ("largest", "") and posting_of("only text") is None and posting_of("") is None
    assert posting_of("<div>first</div><div>other</div>") == ("largest", "first")  # of equals the first
    assert len(posting_of("<main>" + "word " * 10_000 + "</main>")[1]) == 20_000
    tree = Tree("<div>" * 3000 + "deep" + "</div>" * 10)
    assert tree.text(0) == "deep" and tree.parents[2999] == 2998


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_registered_query(spark):
    """The test pages have one article each, some of them not closed."""
    pages = {r.page_id: r.html for r in Tables(spark, FOLDER).pages.collect()}
    rows = registry.queries()["f41_posting_text"](spark, FOLDER).collect()
    assert len(rows) == len(pages)
    import html

    for r in rows:
        page = re.sub(r"(?is)<(script|style|nav|footer|header|aside|iframe|noscript)\b.*?</\1>|<!--.*?-->", "", pages[r.page_id])
        m = re.search(r"(?is)<article[^>]*>(.*?)(?:</article>|</body>|</html>|$)", page)
        if m:
            want = [x.strip() for piece in re.split(r"<[^>]*>", m[1]) for x in html.unescape(piece).split("\n") if x.strip()]
            assert (r.source, r.text) == ("article", "\n".join(want)[:20_000])
    assert sum(r.source == "article" for r in rows) > len(rows) // 2


def test_nulls(spark):
    df = spark.createDataFrame([(None,), ("",), ("<main>x</main>",)], "h string")
    assert [(r.p.source, r.p.text) for r in df.select(posting("h").alias("p")).collect()] == [(None, None), (None, None), ("main", "x")]
