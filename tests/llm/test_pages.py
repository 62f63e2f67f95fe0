import time

import pytest

from contactmill.llm import pages

CASES = [
    ("<p>a &amp; b&nbsp; c<br>d</p>", "a & b c d"),
    ("<nav>menu</nav><div class=ad>buy</div><article><h1>T</h1><p><b>x<br><p>y</article><footer>&copy;</footer>", "T\nx\ny"),
    ("<script>var t='</p>';</script><style>p{}</style><main><ul><li>1<li>2</ul></main>tail", "1\n2"),
    ("<article><p>t</p><section class='comments'><p>me too</p></section><form><p>mail</p></form></article>", "t"),
    ("<!-- <p>no</p> --><p title='a > b'>yes</p><aside>no</aside><div role=navigation>no</div>", "yes"),
    ("<p>open", "open"), ("", ""), (None, ""), ("a < b", "a < b"), ("<script>x", ""), ("<p>&am &quo;</p>", "&am &quo;"),
]


def test_markup():
    for source, text in CASES:
        assert pages.Page(source).main_text() == text, source


def test_templates(spark):
    rows = []
    for i in range(30):
        rows.append((i, f"http://a.com/{i}", f"<div><p>All rights of a</p></div><div><p>own text {i}</p></div>", "x"))
        rows.append((100 + i, f"http://b.com/{i}", f"<article><p>shared passage</p><p>own {i}</p></article>", "x"))
        rows.append((200 + i, "http://c.com/", "<div><p>one page</p></div><div><p>stored often</p></div>", "x"))
    rows += [(None, None, None, "x"), (7, "not a url [", "<p>alone</p>", "x"), (7, "not a url [", "<p>alone</p>", "x")]
    table = spark.createDataFrame(rows, "id long, source_url string, raw_text string, text string")
    out = pages.extract_main_text(table).collect()
    assert len(out) == len(rows)
    text = {}
    for r in out:
        text.setdefault(r["id"], []).append(r["text"])
    assert text[3] == ["own text 3"] and text[103] == ["shared passage\nown 3"]
    assert text[203] == ["one page\nstored often"] and text[None] == [""] and text[7].count("alone") == 2
    assert pages.extract_main_text(table.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["div", "section", "li", "p", "x-y"])
def test_deep_and_long_pages(tag):
    begin = time.time()
    page = pages.Page("<article><h1>T</h1>" + f"<{tag}>t " * 60_000 + "</article>")
    assert page.main_text().count("t") == 60_000 and time.time() - begin < 20


def test_equal_subtrees_have_equal_hashes():
    same = "<div>a<section>b</section> c</div>"
    shapes = [same, "<div>a b<section></section> c</div>", "<div>a<section>b c</section></div>", "<div>a<section>b</section><i>c</i></div>", "<div>ab<section></section>c</div>"]
    outer = [pages.Page(s).elements[0][1] for s in shapes]
    assert outer[0] == outer[3] and len(set(outer)) == 4
    assert set(pages.Page(same).subtrees()) < set(pages.Page(f"<nav>x</nav>{same}").subtrees())
    assert len(pages.Page(same + same).subtrees()) == 2


def test_repeats_with_neutral_names_go_by_their_count(spark):
    plain = '<div class="k3"><div class="q">Subscribe by <b>mail</b></div></div>'
    rows = []
    for i in range(20):
        inside = f'<article><h1>Title {i}</h1><div class="k7"><p>Own text {i}</p></div>{plain}<p>A passage that pages share</p></article>'
        rows.append((i, f"http://a.com/{i}", f'<div class="k1">Top of the site</div>{inside}<div class="k9">Bottom</div>'))
    table = spark.createDataFrame(rows, "id long, source_url string, raw_text string")
    assert pages.Page(rows[4][2]).main_text() == "Title 4\nOwn text 4\nSubscribe by mail\nA passage that pages share"
    for r in pages.extract_main_text(table).collect():
        assert r["text"] == f"Title {r['id']}\nOwn text {r['id']}\nA passage that pages share"
    for r in pages.extract_main_text(table.where("id < 9")).collect():  # too few pages to tell
        assert "Subscribe by mail" in r["text"]
