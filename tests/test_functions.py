from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from loomspan.functions import models, strings, urls
from loomspan.functions.vectors import METRICS

PAIRS = [
    ("https://h/a/b", "c"), ("https://h/a/b/", "../c"), ("https://h/a", "/x/y.html?q=1#f"), ("https://h", "x"), ("https://h/a/b", "//o/p"),
    ("https://h/a/b?x=1", "#top"), ("https://h/a/b", "http://z/q?r"), ("https://h/a/b/c", "../../d"), ("https://h/a/b", "./e"), ("https://h/a/", ".."),
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text", ["", "  a b\n", "a\r\nb\n\nc", "a b", "\n", "x\x0by"])
def test_strings_follow_python(spark, text):
    t = F.lit(text)
    assert one(spark, strings.strip(t)) == text.strip()
    assert one(spark, strings.split_words(t)) == text.split()
    assert one(spark, strings.split_lines(t)) == text.splitlines()


@pytest.mark.parametrize(("base", "href"), PAIRS)
def test_resolve_follows_urljoin(spark, base, href):
    want = urljoin(base, href).split("#")[0].split("?")[0]
    assert one(spark, urls.resolve(F.lit(base), F.lit(href))) == want


@pytest.mark.parametrize(
    ("url", "name"), [("https://h/a/b%20c/?x=1", "web__a-b-20c.md"), ("https://h.org/", "web__h.org.md"), ("https://h/---", "web__index.md"), ("https://h/a/b.html#z", "web__a-b.html.md")]
)
def test_markdown_names(spark, url, name):
    assert one(spark, urls.markdown_name(F.lit(url))) == name


def test_pdf_names_and_predicates(spark):
    assert one(spark, urls.pdf_name(F.lit("https://h/x/Doc.PDF?y"))) == "Doc.PDF"
    assert one(spark, urls.pdf_name(F.lit("https://h/x/doc"))) == "doc.pdf"
    assert len(one(spark, urls.pdf_name(F.lit("https://h/")))) == 20
    assert one(spark, urls.is_pdf(F.lit("https://h/x.PDF?a=b"))) and not one(spark, urls.is_pdf(F.lit("https://h/x?y=.pdf")))
    assert one(spark, urls.is_skipped(F.lit("https://h/a.JPG"))) and not one(spark, urls.is_skipped(F.lit("https://h/a.b/c")))
    assert not one(spark, urls.is_page_link(F.lit("mailto:a@b"))) and one(spark, urls.is_page_link(F.lit("a")))


def test_shorten_and_bar(spark):
    assert one(spark, strings.shorten(F.lit("**a** *b* `c`"))) == "a b c"
    assert one(spark, strings.shorten(F.lit(None).cast("string"))) == "—"
    assert one(spark, strings.shorten(F.lit("x" * 130))) == "x" * 120 + "…"
    assert one(spark, strings.text_bar(F.lit(0.5))) == "█" * 10 + "░" * 10


def test_metrics(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert one(spark, METRICS["cosine"](a, b)) == pytest.approx(1 - 24 / 25)
    assert one(spark, METRICS["l2sq"](a, b)) == pytest.approx(2)
    assert one(spark, METRICS["ip"](a, b)) == pytest.approx(-23)
    assert one(spark, METRICS["cosine"](a, F.array(F.lit(0.0), F.lit(0.0)))) is None


def test_hints_and_router(spark):
    e = one(spark, models.entities(F.lit("¿Qué reglamento de TFG tiene el doble grado?")))
    assert e.degrees == ["doble grado", "doble"] and e.rules == ["tfg", "reglamento"] and e.needs_graph
    assert not one(spark, models.entities(F.lit("hola"))).needs_graph
    assert one(spark, models.asks_for_listing(F.lit("¿Qué grados hay?"))) and not one(spark, models.asks_for_listing(F.lit("hola")))
    blank = one(spark, models.routed(F.lit("  ")))
    assert (blank.intent, blank.is_safe, blank.proceed) == ("saludo", True, False)
    unsafe = one(spark, models.routed(F.lit("x"), safe=F.lit(False)))
    assert (unsafe.intent, unsafe.blocked, unsafe.proceed) == ("malicioso", True, False)
    assert one(spark, models.routed(F.lit("x"))).proceed


def test_query_pool_and_lines(spark):
    pool = one(spark, models.query_pool(F.lit("q"), F.array(*map(F.lit, "abcd")), F.lit("")))
    assert pool == ["q", "a", "b", "c"]
    assert one(spark, models.query_pool(F.lit("q"), F.lit(None).cast("array<string>"), F.lit("h"))) == ["q", "h"]
    assert one(spark, models.variation_lines(F.lit("\n a \n\nb\nc\nd"))) == ["a", "b", "c"]
    assert one(spark, models.valid_question(F.lit(" x "))) and not one(spark, models.valid_question(F.lit(" "))) and not one(spark, models.valid_question(F.lit("x" * 1001)))


def test_rule_provider_vectors(spark):
    v = one(spark, models.RuleProvider(16).embed(F.lit("a b a")))
    assert len(v) == 16 and sum(x * x for x in v) == pytest.approx(1)


def test_outcomes(spark):
    def outcome(proceed, context):
        return one(spark, models.ask_outcome(F.lit(proceed), F.lit(context), F.lit("a"), F.lit(7), F.lit(1.5), "m"))

    assert (outcome(False, True).model_name, outcome(False, True).tokens_used) == ("router", None)
    assert outcome(True, False).model_name == "none" and outcome(True, True) == ("m", "a", 7, 1.5)
