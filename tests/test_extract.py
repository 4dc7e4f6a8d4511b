import json
import time

from pyspark.sql import functions as F

from siteledger.operators import extract as X
from siteledger.operators.html import closed_elements, elements_of, html_elements

CTX = '"@context":"https://schema.org"'
PAGES = {
    1: '<section vocab="http://schema.org/" typeof="schema:Recipe"><h2 property="schema:title"> Soup </h2>'
       '<meta property="yields" content="4 bowls"><ul><li property="step">Boil<li property="step">Stir</ul></section>'
       '<aside vocab="https://schema.org/"><p typeof="Place" property="spot">Here <em property="code">Z9</em></p></aside>'
       '<em property="code">outside</em>',
    2: '<section itemscope itemtype="https://schema.org/Event"><meta itemprop="startDate" content="2031-05-06">'
       '<img itemprop="poster" src="p.png"><h3 itemprop="title"> Fair</h3><i itemprop=note></i><i itemprop=note>free</i>'
       '<i itemprop=note></i><div itemprop=at itemscope itemtype="https://schema.org/Place"><b itemprop=hall>H</b></div></section>',
    3: f"""<script id="__NEXT_DATA__">{{"list":[[{{{CTX},"@type":"Menu","of":{{"@type":"Dish",{CTX}}}}}]],"7":{{{CTX},"@type":"Hours","open":2.50}}}}</script>
       <script dangerouslySetInnerHTML='{{{CTX},"@type":"Menu","of":[1e21,{{}}]}}'></script>""",
    4: "<p>nothing",
    5: None,
    6: f"""<script type="application/ld+json">[{{{CTX},"@type":"A","b":{{"x":1}}}},{{{CTX},"@type":"A","b":{{"x":2}}}},"s",null]</script>
       <script type="application/ld+json">{{"@context":["https://schema.org"],"@type":"B","checksum":"q","v":1.50}}</script>
       <script>x={{{CTX},"@type":"C"}};y={{"a":1}}</script><script type="application/ld+json">{{{CTX}}};</script>
       <script type="application/ld+json"> </script>""",
    7: '<section itemscope><b itemprop="title">T</b></section><p vocab="https://example.net/" typeof="Recipe">'
       '<em property="title">T</em></p><script>let o = {"@context":"https://example.net","@type":"Recipe"};</script>',
    8: f'<script type="application/ld+json">{{{CTX},"@type":"D","a":1,"a":2}}</script>',
}
WANT = {
    1: [{"@type": "Recipe", "title": "Soup", "yields": "4 bowls", "step": ["Boil", "Stir"]},
        {"@type": "Place", "spot": "Here Z9", "code": "Z9"}],
    2: [{"@type": "Event", "startDate": "2031-05-06", "poster": "p.png", "title": "Fair", "note": ["free", ""]}],
    # Hours is also a flat object in a plain script, so the inline search finds it first.
    3: [{"@type": "Hours", "open": 2.5},
        {"@type": "Menu", "of": {"@type": "Dish", "@context": "https://schema.org"}}, {"@type": "Menu", "of": [1e21, {}]}],
    4: [], 5: [], 7: [],
    6: [{"@type": "A", "b": {"x": 1}}, {"@type": "B", "v": 1.5, "@context": ["https://schema.org"]}, {"@type": "C"}],
    8: [{"@type": "D", "a": 2}],
}


def frame(spark):
    return spark.createDataFrame(list(PAGES.items()), "page_id int, html string")


def test_extract_page(spark):
    rows = {r.page_id: r for r in X.extract_page(frame(spark)).collect()}
    assert set(rows) == set(PAGES)
    for page_id, want in WANT.items():
        objects = [json.loads(o) for o in rows[page_id].objects]
        assert objects == [{"@context": "https://schema.org", **w} for w in want], page_id
    assert rows[5].bytes_downloaded == 0 and rows[5].details == X.PAGE_UNREADABLE
    assert rows[4].checksum.startswith("44136fa3")
    assert rows[2].first_keys == ["startDate", "poster", "title", "note", "@context", "@type"]


def test_strict_dedupe_keeps_nested_differences(spark):
    page = {r.page_id: r for r in X.extract_page(frame(spark), strict=True).collect()}[6]
    assert len(page.objects) == 4


def test_raw_blocks(spark):
    rows = X.raw_jsonld_blocks(frame(spark)).filter("page_id = 6").orderBy("pos").collect()
    assert len(rows) == 4 and rows[3].raw == " "


def test_strip_result_tail(spark):
    df = spark.createDataFrame([(['{"a":1}', '{"checksum":"x"}'],), (['{"checksum":""}'],), ([],)], "i array<string>")
    got = [r.o for r in df.select(X.strip_result_tail(F.col("i")).alias("o")).collect()]
    assert got == [['{"a":1}'], ['{"checksum":""}'], []]


def rows_of(source):
    return [(r["tag"], dict(r["attrs"]), r["text"]) for r in elements_of(source, "all")]


def test_tokenizer():
    assert rows_of("<a title=it's href='x'>y</a>") == [("a", {"title": "it's", "href": "x"}, "y")]
    assert rows_of('<A HREF="/?a=1&amp;b&copy=2" href=z>') == [("a", {"href": "/?a=1&b&copy=2"}, "")]
    assert rows_of("<!--><a href=x>y</a>") == [("a", {"href": "x"}, "y")]
    assert rows_of('<p itemprop=a>one<div>two</div>')[0][2] == "one"
    assert rows_of("<ul><li itemprop=a>1<li itemprop=a>2</ul>x")[1][2] == "1"
    assert rows_of("<script>var a = '</p>';</script><b>")[0][0] == "script"
    assert rows_of("<b itemprop=a>x<p>y</b>z</p>")[0][2] == "xy"


def test_every_page_keeps_a_document_row(spark):
    counts = html_elements(frame(spark)).filter("tag = '#document'").count()
    assert counts == len(PAGES)


def test_nesting_of_any_depth(spark):
    """Deep documents neither end the job nor lose objects."""
    pages = []
    for n, depth in enumerate((600, 5000)):
        inner = "[" * depth + "]" * depth
        pages.append((2 * n, f'<script type="application/ld+json">{{{CTX},"@type":"A","v":{inner},"o":{{"x":1}},"checksum":"c"}}</script>'))
        pages.append((2 * n + 1, f'<script id="__NEXT_DATA__">{{"a":{inner},"b":{{{CTX},"@type":"B","v":{{"w":{inner}}}}}}}</script>'))
    rows = X.extract_page(spark.createDataFrame(pages, "page_id int, html string")).orderBy("page_id").collect()
    for (n, _), row in zip(pages, rows):
        depth = (600, 5000)[n // 2]
        inner = "[" * depth + "]" * depth
        want = f'"@type":"A","o":{{"x":1}},"v":{inner}' if n % 2 == 0 else f'"@type":"B","v":{{"w":{inner}}}'
        assert row.objects == [f"{{{CTX},{want}}}"], n


def test_unclosed_elements_take_no_more_than_their_texts():
    n = 20_000
    rows, size = 0, 0
    for row in closed_elements("<span itemprop=x>ab" * n, "marked"):
        # Rows come one by one: the innermost first, each with the text from it to the end.
        rows += 1
        size += len(row["text"])
        assert row["elem_id"] == n + 1 - rows and len(row["text"]) == 2 * rows
    assert rows == n and size == n * (n + 1)
    start = time.process_time()
    deep = sum(1 for _ in closed_elements("<i typeof=T>" * n + "<div><li></b>" * n + "</i>" * n, "marked"))
    assert deep == n and time.process_time() - start < 20


def test_rows_are_given_when_their_element_ends():
    rows = closed_elements("<p itemprop=a>one<p itemprop=b>two<b itemprop=c>x<div itemprop=d>y</b>z</div>" + "<br>" * 5, "marked")
    assert [(r["elem_id"], r["text"]) for r in rows] == [(1, "one"), (3, "x"), (2, "twox"), (4, "yz")]
    nested = "<b typeof=A><u typeof=B><i property=p>t</i></u><i property=q>t</i></b>"
    assert [r["typed_ids"] for r in elements_of(nested, "marked") if r["typed_ids"] is not None] == [[1, 2], [1]]
