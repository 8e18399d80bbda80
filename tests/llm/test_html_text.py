import pytest
from llm_rows import prose
from lonetext.llm import html_text as ht

TREE = ht.trained()
CASES = {
    "": "",
    "plain words " * 20: ("plain words " * 20).strip(),
    "<article><h1>A &amp; B</h1><p>x  <b>y</b>\n z<br>w</article>": "A & B\nx y z w",
    "<nav><ul><li><a href=/>Home</a></li></ul></nav><article><p>Text here.</article><footer>&copy; me</footer>": "Text here.",
    "<article><p>One.<div class='ad'>Buy this now</div><p>Two &amp;lt; 3</article>": "One.\nTwo &lt; 3",
    "<head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><article>Body</article>": "Body",
    "<article>A<!-- not <p> this -->B<script>if (a<b) x()</script>C</article>": "ABC",
    "<main><p>Keep.</p><aside>Side note text</aside><section id=comments><p>Great post!</p></section></main>": "Keep.",
    "<article><p title='a > b'>Quoted</p><form><input value=x>Name</form></article>": "Quoted",
    "<article><p>1 < 2 and 3 > 2</p></article>": "1 < 2 and 3 > 2",
    "<div class=cookie-notice>We use cookies</div><article><p>Real</article><div role=navigation>x y</div>": "Real",
    "<article><p>end <b": "end",
    "<article></div></span><p>stray</p></article>": "stray",
    "<article><p>  wide　space </p></article>": "wide space",
    "<ARTICLE><P>Upper</P></ARTICLE><FOOTER>low</FOOTER>": "Upper",
    "<!-- open <article>x": "",
}


@pytest.mark.parametrize("page", CASES, ids=range(len(CASES)))
def test_pages(page):
    assert ht.main_text(page, TREE) == CASES[page]


def test_tree_fits_its_table_and_is_small():
    assert all(TREE.decide(r[:-1]) == bool(r[-1]) for r in ht.LABELLED.tolist())
    assert len(TREE.feature) <= 25


def test_pages_without_marks():
    link = "<div><a href=x>menu</a></div>"
    page = link * 4 + f"<div>{prose(1, 60)}</div><div>{prose(2, 50)}</div>" + link * 3
    assert ht.main_text(page, TREE) == prose(1, 60) + "\n" + prose(2, 50)


def test_table(spark):
    rows = [(1, "u", "<article><p>Ünï</article>", "other"), (2, None, None, "x"), (None, "u", "", "x"), (1, "u", "<article><p>Ünï</article>", "y"),
            (5, "u", "<article>" + "<p>long words here</p>" * 20_000 + "</article>", "z")]
    df = ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    found = [(r.page_id, r.text[:3], r.n_chars) for r in df.collect()]
    assert found == [(1, "Ünï", 3), (2, "", 0), (None, "", 0), (1, "Ünï", 3), (5, "lon", 20_000 * 16 - 1)]
    assert ht.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_generated_pages(spark, sf):
    """The pages of the test tables: heading and paragraphs of the article, found by a plain search."""
    import re
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in ht.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in parts if x)
