"""Main text of pages: templates with and without semantic marks, and odd markup."""

import random

from cartulary.llm.sitetree import main_blocks, main_text

SCHEMA = "page_id long, url string, html string, text string"


def _text(source):
    return " ".join(b.text for b in main_blocks(source)[0])


def test_marked_article():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="</p>";</script></head><body class="menu">
    <header><h1>Site</h1></header><nav><ul><li><a>Home</a></ul></nav><div class="cookie-notice">We use</div><!-- x <p>no</p> -->
    <div class="ad">Buy</div><article><header><h1>A &amp; B</h1></header><p><b>One<br>two&nbsp; three<p>fo<i>u</i>r &lt;x&gt; &#233;<form>f<input></form>
    <aside>side</aside><section id="comments"><p>first!</p></section></article><aside>s</aside><footer>&copy;</footer>"""
    assert _text(page) == "A & B One two three four <x> é"


def test_odd_markup():
    assert _text(None) == _text("") == ""
    assert _text("plain &amp; text") == "plain & text"
    assert _text("<p>a</b></div><p>b<script>never closed <p>c") == "a b"
    assert _text("<div>a<div hidden>b</div>c</div> 1 < 2") == "a c 1 < 2"
    assert _text("<ul><li>x<li>y<ul><li>z</ul></ul>" * 2) == "x y z x y z"
    assert len(_text("<p>" + "word " * 200_000)) == 5 * 200_000 - 1


def test_site_tree_removes_what_a_site_repeats(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice(("red", "green", "blue", "fast", "slow")) + str(rng.randint(0, 10**6)) for _ in range(n))
    rows, wanted = [], {}
    for number in range(30):
        body = [words(20) for _ in range(3)]
        blocks = "".join(f"<div class='t'>{b}</div>" for b in body)
        rows.append((number, f"https://a.example/{number}", f"<div class='x1'><div>Welcome here</div><div>Call us now</div></div>{blocks}<div class='y'>All rights</div>", "n"))
        wanted[number] = " ".join(body)
    rows.append((100, "https://b.example/", rows[0][2], "n"))
    wanted[100] = f"Welcome here Call us now {wanted[0]} All rights"
    rows += [(101, None, None, None), (102, "", "", None)]
    wanted |= {101: "", 102: ""}
    found = main_text(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {r["page_id"]: r["text"] for r in found} == wanted and all(r["n_chars"] == len(r["text"]) for r in found)
    assert main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_pages_keep_the_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    sources = {r["page_id"]: r["html"] for r in pages.collect()}
    for row in main_text(pages).collect():
        inner = sources[row["page_id"]].split("<article>")[1].split("</article>")[0]
        assert row["text"] == " ".join(b.text for b in main_blocks(inner)[0]) and row["n_chars"] > 0
