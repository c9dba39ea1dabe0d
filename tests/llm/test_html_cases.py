"""Names of page parts, articles and comments, through the registered query on small page tables."""

import pytest

from framelake.llm import html_text, queries

CASES = {
    "class of a layout": ('<body><div class="content no-sidebar"><p>one two</p></div></body>', "one two"),
    "layout inside an article": ('<article><div class="layout with-sidebar"><p>one two</p></div></article>', "one two"),
    "a part by its whole name": ('<body><div class="site-sidebar">links</div><div class="sidebar left">more</div><p>one two three four five six</p></body>', "one two three four five six"),
    "anchors inside an article": ('<article><h2 id="navigation-at-sea">Sailing</h2><section id="menu-pricing"><p>prices</p></section></article>', "Sailing\nprices"),
    "words of a title": ('<article><p title="the hidden gem">a gem</p><p title="class=ad id=menu">b</p></article>', "a gem\nb"),
    "other attributes": ('<article><p data-id="ad" data-class="menu">text</p></article>', "text"),
    "hidden": ('<article><p hidden>x</p><p hidden="">x</p><p style="color:red; display : none">x</p><div aria-hidden="true">x</div><p style="color:red">seen</p></article>', "seen"),
    "comments as articles": ('<article><p>story</p></article><div class="thread"><article class="comment"><p>nice</p></article></div>', "story"),
    "an article inside an article": ('<article><p>story</p><div class="below"><article><p>reply</p></article></div></article>', "story"),
    "comments inside an article": ('<article><p>story</p><section class="comments"><p>a very long comment by a reader who likes to write</p></section></article>', "story"),
    "a name around most of the text": ('<body><div class="sidebar-layout"><p>the long text of this page</p></div><p>short</p></body>', "the long text of this page\nshort"),
    "a name around the only article": ('<body><div>a long line of words beside the article, longer than it</div><div class="menu-page"><article><p>story</p></article></div></body>', "story"),
    "teasers in a sidebar": ('<body><article><p>the whole story of the day</p></article><div class="sidebar"><article><p>teaser</p></article></div></body>', "the whole story of the day"),
    "an empty comment": ("<article><p>a<!--> b</p><p>c<!---> d</p><p>e<!-- x --> f<!-- y --!> g</p></article>", "a b\nc d\ne f g"),
    "advert in a line": ('<article><p>first <span class="ad">buy</span> second</p><div class="ad-slot">buy</div></article>', "first second"),
    "no comment closes": ("<article><p>a</p><!-- b <p>c</p>", "a"),
}


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    def query(pages):
        folder = tmp_path_factory.mktemp("pages")
        spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
        got = queries.QUERIES["op9_html_extraction"](spark, str(folder)).toPandas()
        assert (got.n_chars == got.text.map(len)).all()
        return dict(zip(got.page_id, got.text, strict=True))

    return query


def test_cases(run):
    got = run([(i, f"http://host{i}.org/a", page) for i, (page, _) in enumerate(CASES.values())])
    assert {name: got[i] for i, name in enumerate(CASES)} == {name: text for name, (_, text) in CASES.items()}


def test_lists_that_repeat_in_articles(run):
    """Four recipes of a host share their ingredients; its navigation and notes around the article go."""
    page = '<body><div class="x"><ul><li>home</li></ul></div><article><h1>Cake {0}</h1><div class="box"><ul><li>200 g flour</li><li>salt</li></ul></div><table><tr><td>30 min</td></tr></table><p>Step {0}</p></article><div>our other cakes</div></body>'
    got = run([(i, f"http://cakes.org/{i}", page.format(i)) for i in range(4)])
    assert got == {i: f"Cake {i}\n200 g flour\nsalt\n30 min\nStep {i}" for i in range(4)}


def test_templates_without_names(run):
    """Without an article, what recurs on a host's pages is template; inside one, only on half of the host's pages and five of them."""
    plain = "<body><div><p>welcome to the site</p></div><div><p>text {0} of the page</p></div><div>imprint</div></body>"
    got = run([(i, f"http://plain.org/{i}", plain.format(i)) for i in range(5)])
    assert got == {i: f"text {i} of the page" for i in range(5)}
    boxed = "<body><article><p>story {0}</p><div>read more on our site</div></article></body>"
    many = run([(i, f"http://boxed.org/{i}", boxed.format(i)) for i in range(html_text.INSIDE_PAGES)])
    assert many == {i: f"story {i}" for i in range(html_text.INSIDE_PAGES)}
    few = run([(i, f"http://boxed.org/{i}", boxed.format(i)) for i in range(html_text.INSIDE_PAGES - 1)])
    assert few == {i: f"story {i}\nread more on our site" for i in range(html_text.INSIDE_PAGES - 1)}
