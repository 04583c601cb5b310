from tuplequarry.llm.html_tree import extract_main_text, main_text

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body class='has-sidebar'>"
    "<nav><ul><li><a href='/x'>Menu<li>Two</ul></nav><div class=ad>Buy</div><div class='cookie-notice'>We use</div>"
    "<article><h1>Title &amp; more</h1><p><b>One\n  two<br>three<p>Four&nbsp;five <i>si</i>x &lt;b&gt;"
    "<aside>note</aside><ul><li>a<li>b</ul><form><input><button>Go</button></form></article>"
    "<section id='comments'><article class='comment'>Nice!</article></section><footer>&copy; us</footer></body>"
)


def test_page():
    assert main_text(PAGE) == "Title & more One two three Four five six <b> a b"


def test_broken():
    assert main_text("") == "" and main_text("plain & simple") == "plain & simple"
    assert main_text("<article><p>cut off <b>here</b> <a hre") == "cut off here"
    assert main_text("<article>a<!-- b --><p>c</article") == "a c"
    assert main_text("<p>x</p>" * 3000).count("x") == 3000
    assert main_text("<div>" * 5000 + "deep") == "deep"
    assert main_text("<form><main>kept</main></form>") == "kept"
    assert main_text("a < b and c > d <3") == "a < b and c > d <3"


def test_site_style_tree(spark):
    page = lambda i: f"<html><body><div class='top'>Our site</div><div class='body'><p>text number {i} " + f"{i * 7919} words</p></div><div class='end'><p>The same end</p></div></body></html>"
    rows = [(i, f"http://a.com/{i}", page(i)) for i in range(40)] + [(100 + i, f"http://b.com/{i}", page(7)) for i in range(40)]
    rows += [(200, "http://few.com/", page(1)), (201, None, None), (202, "x", ""), (203, "http://a.com/0", page(0)), (203, "http://a.com/0", page(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' as host", "1 as low", "2 as text")
    got = {r.page_id: r for r in extract_main_text(df).collect()}
    assert extract_main_text(df).count() == len(rows)
    assert got[5].text == "text number 5 39595 words" and got[5].n_chars == len(got[5].text)
    # copies of one page teach nothing about the template: everything stays
    assert got[105].text == "Our site text number 7 55433 words The same end" and got[200].text.startswith("Our site")
    assert got[201].text == "" and got[202].text == "" and got[203].text == "text number 0 0 words"
    assert extract_main_text(df.limit(0)).count() == 0


def test_text_deeper_than_64(spark):
    deep = lambda i: f"<html><body><h1>Heading</h1>{'<div>' * 100}<p>body number {i}</p>{'</div>' * 100}</body></html>"
    df = spark.createDataFrame([(i, f"http://deep.com/{i}", deep(i)) for i in range(12)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    assert got == {i: f"body number {i}" for i in range(12)}
