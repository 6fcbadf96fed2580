import html
import re

from millrace.llm.html_blocks import extract, main_text


def plainly(page):
    """The article of the test pages, taken apart with patterns that fit only them."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
    return "\n".join(b for b in blocks if b)


def test_every_page(spark):
    from millrace.llm.queries import QUERIES

    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
        found = QUERIES["op1_html_blocks"](spark, sf).collect()
        assert len(found) == len(pages)
        for r in found:
            assert r.text == plainly(pages[r.page_id].html)
            assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


LONG = "word " * 40


def test_pages_without_article():
    page = f"<div class=menu><ul><li><a href=x>Home</a></ul></div><div id=content><h2>Title</h2><p>{LONG}<p>Short.<p>{LONG}<div class='comments'><p>{LONG}</div></div><div class=footer>c</div>"
    assert main_text(page) == f"Title\n{LONG.strip()}\nShort.\n{LONG.strip()}"
    assert main_text("only text") == "only text"


def test_windows_choose_the_text_of_unmarked_pages(monkeypatch):
    """No tag or class tells text from the rest here; without the windows the rest would stay."""
    from millrace.llm import html_blocks

    gap = "<hr>" + "<div><a href=x>more</a></div>" * 4
    page = f"<div>Tiny shop</div><div>since 1999</div>{gap}<h1>Head</h1><p>{LONG}</p><p>Yes.</p><p>{LONG}</p>{gap}<p>Between.</p>{gap}<p>{LONG}</p>{gap}<div>Legal stuff</div><div>by us</div>"
    text = "\n".join(["Head", LONG.strip(), "Yes.", LONG.strip(), "Between.", LONG.strip()])
    assert main_text(page) == text
    monkeypatch.setattr(html_blocks, "surges", lambda weights: [(0, len(weights))])
    assert main_text(page) != text


def test_short_end_of_an_article_after_an_advert():
    assert main_text(f"<article><p>{LONG}</p><div class=ad>x</div><p>Short end.</p></article>") == f"{LONG.strip()}\nShort end."
    assert main_text("<article><p>A.</p></article>") == "A."


def test_boilerplate_in_and_around_the_article():
    page = "<header>Site</header><div class='cookie-notice'>We use</div><main><article><h1>A &amp; B&#33;</h1><p>x <b>y</b>z<aside>no</aside><form>q</form><p>1\n 2&nbsp;3<ol class=commentlist><li>c</ol></article><article>small</article></main><footer>f"
    assert main_text(page) == "A & B!\nx yz\n1 2 3"


def test_broken_markup():
    assert main_text("<nav>never closed <article><p>hello</article>") == "hello"
    assert main_text("<p>a<script>if(a<b){'</p>'}</script>b") == "a\nb"
    assert main_text("<article><p class=ad>buy<p>text</article>") == "text"
    assert main_text("<article><p>a<p class=ad>buy <b>now</b> ok<p>text &am</article>") == "a\ntext &am"
    assert main_text("<!-- x") == ""
    assert len(main_text("<div>" * 30000 + "x")) == 1
    assert main_text('<article><a title="x>' * 3000).strip() == ""


def test_rows(spark):
    rows = [(1, "u", None), (None, None, "<article>a</article>"), (2, "u", ""), (2, "u", ""), (3, "v", "<article>" + "<p>long text</p>" * 20000 + "</article>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    found = {(r.page_id, r.url): r.text for r in extract(pages).collect()}
    assert extract(pages).count() == 5
    assert found == {(1, "u"): "", (None, None): "a", (2, "u"): "", (3, "v"): "\n".join(["long text"] * 20000)}
    assert extract(pages.limit(0)).count() == 0
