import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import text

PAGE = """<html><head><title> My <b>page</b></title></head><body><nav><a href="/n">n</a><li>menu</li></nav>
<article id="x"><h1>Head &amp; more</h1><p>First <i>para</i>.</p><ul><li><p>inner</p></li><li>plain</li></ul><table><tr><td>cell</td></tr></table>
<a href="sub/page.html?q#f">go</a><a href="mailto:x@y">m</a><a href="pic.JPG">p</a></article><footer><p>foot</p></footer></body></html>"""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_outline():
    assert text.outline(PAGE).split("\n\n") == ["# Head & more", "First para .", "- inner", "inner", "- plain", "cell"]
    assert text.outline("<body><p>only</p></body>") == "only" and text.outline("") == "" and text.outline("<p>loose</p>") == ""


def test_pages(spark):
    pages = spark.createDataFrame([(1, "https://h/a/b", PAGE), (2, "https://h/c", "<body><p>x</p></body>"), (3, "https://h/d", None)], "page_id long, url string, html string")
    md = {r.page_id: (r.title, r.markdown) for r in text.page_markdown(pages).collect()}
    assert md[1][1].startswith("# Head & more") and md[2] == ("https://h/c", "# https://h/c\n\nx") and md[3] == ("https://h/d", "")
    assert {r.link for r in text.page_links(pages).collect()} == {"https://h/a/sub/page.html"}
    assert {r.link for r in text.page_links(pages, True).collect()} == {"https://h/a/sub/page.html", "https://h/n"}


def test_noise_lines(spark):
    raw = "keep\n- 12 -\nPágina 3 de 10\npage 4 of 9\nhttps://a.b/c\nwww.x.y\n=====\nkeep 12\n\n\n\n\nend"
    assert one(spark, text.finish(text.clean_noise(F.lit(raw)))).split() == ["keep", "keep", "12", "end"]
    own = text.clean_noise(F.lit("x\n  SOME Institute \ny"), (*text.NOISE_LINES, text.line_pattern("some institute")))
    assert one(spark, own).split() == ["x", "y"]
    assert one(spark, text.noise_removed(F.lit("abcd"), F.lit("a"))) == 75.0


def test_runs(spark):
    rows = spark.createDataFrame([(1, "a\n a\na\nb\na\na"), (2, "a\na\n\na\na"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in text.keep_runs(rows).collect()}
    assert got[1] == ("a\n a\nb\na\na", 1) and got[2] == ("a\na\n\na\na", 0) and got[3] == ("", 0)
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["a", " a", "b ", "", "  ", "c"]) for _ in range(rng.randrange(0, 60))) for _ in range(60)] + ["x\n" * 500]
    for most in (1, 2, 3):
        want = {}
        for i, text_ in enumerate(texts):
            kept, last, run = [], None, 0
            for line in text_.splitlines():
                run = run + 1 if line.strip() == last and line.strip() else 1
                last = line.strip()
                kept += [line] if run <= most or not last else []
            want[i] = "\n".join(kept)
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {r.doc_id: r.text for r in text.keep_runs(frame, most=most).collect()} == want


def test_tables_medians_headings(spark):
    table = F.from_json(F.lit('[["a", null], ["b\\nc", "d"]]'), "array<array<string>>")
    assert one(spark, text.table_rows(table)) == "| a |  |\n| --- | --- |\n| b c | d |"
    assert one(spark, text.upper_median(F.array(*map(F.lit, [4.0, 1.0, 3.0, 2.0])))) == 3.0
    assert one(spark, text.upper_median(F.array().cast("array<double>"))) == 10.0
    sizes = spark.createDataFrame([("a", float(x)) for x in (4, 1, 3, 2)] + [("b", 5.0), ("b", 7.0), ("b", 6.0), ("c", None)], "k string, size double")
    assert {r.k: r.m for r in sizes.groupBy("k").agg(text.upper_median_of("size").alias("m")).collect()} == {"a": 3.0, "b": 6.0, "c": 10.0}
    mark = lambda line, ratio: one(spark, text.heading_mark(F.lit(line), F.lit(ratio * 10.0), F.lit(10.0)))
    assert [mark("Mixed", r) for r in (1.6, 1.3, 1.15, 1.0)] == ["#", "##", "###", None]
    assert [mark("CAPS", r) for r in (1.2, 1.0)] == ["#", "###"] and mark("x" * 151, 2.0) is None


def test_words_to_lines_and_pages(spark):
    words = spark.createDataFrame([(1, "b", 20.0, 10.2, 12.0, 9.0), (1, "a", 5.0, 9.8, 12.0, 11.0), (1, "c", 5.0, 30.0, 32.0, 10.0), (1, "t", 6.0, 50.0, 52.0, 10.0)], "page int, text string, x double, top double, bottom double, size double")
    boxes = spark.createDataFrame([(1, 0.0, 100.0, 45.0, 60.0)], "page int, x0 double, x1 double, top double, bottom double")
    got = [(r.line, r["size"], r.gap) for r in text.word_lines(words, boxes).orderBy("row").collect()]
    assert got == [("a b", 10.0, None), ("c", 10.0, 18.0)]
    pages = spark.createDataFrame([("d", 2, "two"), ("d", 1, "one"), ("d", 3, "  ")], "doc string, page int, text string")
    assert text.joined_pages(pages).first().text == "one\n\n---\n\ntwo"
    items = ["• x", "a) y", "1. z", "2) w", "plain"]
    assert [one(spark, text.is_list_item(F.lit(i))) for i in items] == [True] * 4 + [False]


def test_titles_and_sections(spark):
    assert one(spark, text.document_title(F.lit("x\n  # Real \ny"), F.lit("f"))) == "Real"
    assert one(spark, text.document_title(F.lit("## no"), F.lit("a%20b_c-d+e"))) == "a b c d+e"
    md = "intro\n# A\none\n### C\ntwo\n```\n# not a heading\n```\n# B\n## D\nthree"
    got = [(text_, path) for text_, path in (
        (r.text, r.p) for r in text.sections(spark.createDataFrame([(1, md)], "doc_id long, text string"))
        .withColumn("p", text.section_path(*[F.col(f"header_{n}") for n in (1, 2, 3)])).orderBy("section_no").collect()
    )]
    assert got == [("intro", ""), ("# A\none", "A"), ("### C\ntwo\n```\n# not a heading\n```", "A > C"), ("# B", "B"), ("## D\nthree", "B > D")]


@pytest.mark.parametrize("body", ["{} word ", "{}", "para {}.\n\n", "| {} | b |\n", "Sentence {} here. "])
def test_cut(body):
    body = "".join(body.format(i) for i in range(1000, 1900))  # every place is told by its numbers
    parts = text.cut(body)
    assert all(0 < len(p) <= text.MOST for p in parts)
    at = 0
    for p in parts:  # the pieces cover the text in order
        start = body.find(p[:40], max(0, at - text.OVERLAP - 50))
        assert start >= 0
        at = start + len(p)
    assert len(body.rstrip()) - at <= 2


def test_chunks_and_facts(spark):
    docs = spark.createDataFrame([(1, "# T\n" + "long words here. " * 200), (2, "short"), (3, None)], "doc_id long, text string")
    got = text.chunks(docs).collect()
    assert {r.doc_id for r in got} == {1} and all(60 <= len(r.chunk) <= 1500 and r.section == "T" for r in got)
    facts = text.facts(spark.createDataFrame([("f", " a \n\n b\n")], "name string, value string"))
    assert [(r.chunk_index, r.text) for r in facts.collect()] == [(0, "a"), (1, "b")]


def test_titles_are_decoded(spark):
    cases = {"<title>A &amp; B</title>": "A & B", "<title>&#65;&#x42;&lt;c&gt;</title>": "AB<c>", "<h1>a &amp;amp; b</h1>": "a &amp; b", "<title>&#; &#999999; &unknown;</title>": f"&#; {chr(999999)} &unknown;", "<title>&Eacute;&laquo;&ordm;&iexcl;&#128512;&#38;lt;</title>": "É«º¡😀&lt;", "<title> </title>": "u"}
    rows = spark.createDataFrame([(h,) for h in cases], "h string")
    got = {r.h: r.t for r in rows.select("h", text.page_title(F.col("h"), F.lit("u")).alias("t")).collect()}
    assert got == cases


def test_one_parse_gives_links_and_titles():
    page = text.parsed("""<title>T</title><!-- <a href="gone.html">x</a> --><a href=bare.html>b</a><A HREF='two.html' href='three.html'>c</A><a>none</a><a href>empty</a>
        <nav><a href="menu.html">m</a></nav><script>var a = '<a href="script.html">';</script><h1> One <b>two</b></h1>""")
    assert page["links"] == ["bare.html", "two.html", ""] and page["noise_links"] == ["menu.html"] and (page["title"], page["heading"]) == ("T", "Onetwo")
    assert text.parsed("<a href='a?b=1&amp;c=2'>x</a>")["links"] == ["a?b=1&c=2"]


def test_every_reference_is_decoded_as_by_the_standard():
    import html
    from html.entities import html5

    names = [n for n in html5 if n.endswith(";")]
    page = text.parsed("<title>" + " ".join(f"x&{n}x" for n in names) + "</title>")
    assert page["title"].split() == " ".join(f"x{html.unescape('&' + n)}x" for n in names).split()


def test_open_ended_noise_lines(spark):
    raw = "x\n 12 Main Street, y\nacme, 3 of May\nacme stays\nz"
    patterns = (*text.NOISE_LINES, text.line_pattern("12 main street", more=True), text.body_pattern(r"acme,\s+\d+ of \w+"))
    assert [x for x in one(spark, text.clean_noise(F.lit(raw), patterns)).split("\n") if x] == ["x", "acme stays", "z"]


def test_items_and_boxes_by_document(spark):
    items = {"• x": "- x", "▸ y": "- y", "- z": "- z", "a) y": "- a) y", "1) w": "- 1) w", "12. z": "- 12. z", "◦ no": "◦ no", "– no": "– no", "ab) no": "ab) no", "•no": "•no"}
    assert {k: one(spark, text.list_line(F.lit(k))) for k in items} == items
    words = spark.createDataFrame([("d", 1, "in", 10.0, 30.0, 10.0, 20.0, 9.0), ("e", 1, "out", 10.0, 30.0, 10.0, 20.0, 9.0), ("d", 1, "edge", 24.0, 60.0, 10.0, 20.0, 9.0)], "doc string, page int, text string, x double, x1 double, top double, bottom double, size double")
    boxes = spark.createDataFrame([("d", 1, 0.0, 25.0, 0.0, 30.0)], "doc string, page int, x0 double, x1 double, top double, bottom double")
    assert sorted((r.doc, r.line) for r in text.word_lines(words, boxes).collect()) == [("d", "edge"), ("e", "out")]  # a word's middle counts
    assert [r.line for r in text.word_lines(words.filter("doc = 'd'")).collect()] == ["in edge"]


def test_page_text(spark):
    rows = [("d", 1, "Title", 5.0, 10.0, 20.0, 20.0), ("d", 1, "• item", 5.0, 30.0, 40.0, 10.0), ("d", 1, "plain", 5.0, 42.0, 52.0, 10.0), ("d", 1, "far", 5.0, 90.0, 100.0, 10.0)]
    words = spark.createDataFrame(rows, "doc string, page int, text string, x double, top double, bottom double, size double")
    assert text.page_text(text.word_lines(words)).first().text == "\n# Title\n\n- item\nplain\n\nfar"


def test_chunks_carry_their_source(spark):
    long = "word " * 20
    files = spark.createDataFrame([("a.md", f"# Title A\n{long}"), ("web__b.md", long)], "name string, text string")
    sources = spark.createDataFrame([("a.pdf", "https://a"), ("web__b.md", "https://b")], "name string, url string")
    got = {r.source_file: (r.title, r.source_url, r.section) for r in text.file_chunks(files, sources).collect()}
    assert got == {"a.md": ("Title A", "https://a", "Title A"), "web__b.md": ("web  b", "https://b", "")}


def test_words_of_landed_files(spark, tmp_path):
    import json

    from loomspan.sources import readers

    word = lambda t, x, top, size=10.0: {"text": t, "x0": x, "x1": x + 10, "top": top, "bottom": top + 10, "size": size}
    table = {"x0": 0, "x1": 90, "top": 50, "bottom": 90, "rows": [["h", None], ["a", "b"]]}
    (tmp_path / "one.json").write_text(json.dumps({"pages": [{"words": [word("b", 30, 10), word("a", 5, 10), word("t", 10, 60)], "tables": [table]}, {"words": []}]}))
    (tmp_path / "two.json").write_text(json.dumps({"pages": [{"words": [word("c", 5, 10)]}]}))
    (tmp_path / "bad.json").write_text("{")
    results = readers.page_words(spark, str(tmp_path))
    assert {r.doc: r.error for r in results.filter("error IS NOT NULL").collect()}.keys() == {"bad"} and results.count() == 3
    words, boxes, tables = readers.words_of(results), readers.boxes_of(results), readers.tables_of(results)
    assert sorted((r.doc, r.page, r.line) for r in text.word_lines(words, boxes).collect()) == [("one", 1, "a b"), ("two", 1, "c")]
    assert [(r.doc, r.page, r.md) for r in tables.select("doc", "page", text.table_rows(F.col("rows")).alias("md")).collect()] == [("one", 1, "| h |  |\n| --- | --- |\n| a | b |")]
