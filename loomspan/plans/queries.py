"""The engine's queries over the driver's tables; each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import models, strings, times, urls
from loomspan.operators import crawl, evaluation, graph, index, isolation, keywords, logs, text, vector
from loomspan.plans.fixtures import chat_log, degrees_of_orders, eval_results, judged, table
from loomspan.sources.writers import with_ids

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Words of the fixtures that stand for hints, and the queries' other parameters.
HINTS = {"degrees": ["with", "une", "nicht"], "rules": ["that", "para"]}
PART_WORDS = ["ring", "SMALL"]
REQUESTS_A_DAY = 5
SEARCH = {"listing": ["household"], "degrees": ["nation_1", "nation_2"], "rules": ["building"]}
PROBES = 6
#: Noise lines of the fixtures' own institution.
OWN_LINES = (text.line_pattern("Acme Institute"), text.line_pattern("12 main street", more=True), text.body_pattern(r"acme,?\s+\d{1,2} of \w+"))


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


# ---------------------------------------------------------------- vectors


def _search(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    """Every hundredth vector is a question, held against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query"))
    found = vector.nearest(vectors, asked, metric=metric)
    return found.select("question_id", "vec_id", (F.round("distance", 6) + 0.0).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "cosine")


@query
def knn_l2sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "l2sq")


@query
def knn_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "ip")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions are labels; a question's queries are its label's hundredth vectors and the next ones."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter(F.col("vec_id") % 100 < 5).select(
        F.floor(F.col("vec_id") / 100).alias("question_id"), (F.col("vec_id") % 100).alias("query_idx"), F.col("embedding").alias("query")
    )
    hits = vector.nearest(vectors, asked, question=["question_id", "query_idx"])
    return vector.merge_queries(hits, content="vec_id")


@query
def retrieve_multiquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _candidates(spark, sf_dir)
    return found.select("question_id", "vec_id", (F.round("distance", 6) + 0.0).alias("distance"), F.col("position").cast("long").alias("position"))


@query
def retrieve_topk_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores fall with distance; odd questions have one failed score and so fall back to distance."""
    found = _candidates(spark, sf_dir)
    failed = (F.col("question_id") % 2 == 1) & (F.col("position") == 1)
    score = F.when(~failed, F.round(F.lit(3.0) - F.col("distance") * 8, 6))
    top = vector.top_scored(found.withColumn("score", score))
    return top.select("question_id", "vec_id", F.col("rank").cast("long").alias("rank"), "rerank_score")


@query
def knn_inverted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``knn_cosine``, in the ``PROBES`` nearest of the cells around every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    centroids = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("cell"), F.col("embedding").alias("centroid"))
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query"))
    found = index.nearest_in(index.indexed(vectors, centroids), centroids, asked, PROBES)
    return found.select("question_id", "vec_id", (F.round("distance", 6) + 0.0).alias("distance"), F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- collections


@query
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", vector.content_id(F.col("text")).alias("id"))


@query
def upsert_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("text", "source", F.col("doc_id").alias("pos"), vector.batches(F.col("doc_id")).alias("call"))
    return vector.upsert(rows).select("id", "source", F.col("pos").alias("doc_id"), F.col("call").alias("batch"))


@query
def anti_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents count as converted, some of them with another digest."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    files = docs.select(F.col("doc_id").alias("name"), F.sha2("text", 256).alias("sha256"))
    known = labels.join(docs, "doc_id").select(F.col("doc_id").alias("name"), F.sha2(F.when(F.col("quality") == 1, F.col("text")).otherwise(""), 256).alias("sha256"))
    outputs = labels.filter("toxic = 0").select(F.col("doc_id").alias("name"))
    return crawl.changed_files(files, known, outputs).select(F.col("name").alias("doc_id"))


# ---------------------------------------------------------------- log


@query
def log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.log_stats(chat_log(spark, sf_dir)).withColumn("avg_feedback", F.round("avg_feedback", 6))


@query
def log_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.intent_counts(chat_log(spark, sf_dir))


@query
def log_page_p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.log_page(chat_log(spark, sf_dir))


@query
def log_page_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.log_page(chat_log(spark, sf_dir), page=2, where=logs.log_filter("academica", "1", True))


@query
def log_unrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.log_page(chat_log(spark, sf_dir), page=3, where=logs.log_filter(feedback="none"))


@query
def log_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.page_count(chat_log(spark, sf_dir), where=logs.log_filter(is_safe=False))


@query
def feedback_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as feedback: some on unknown rows, some with invalid scores."""
    updates = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 3).cast("int").alias("score"), F.col("o_orderkey").alias("seq"))
    updated, rejected = logs.apply_feedback(chat_log(spark, sf_dir), updates)
    counts = updated.groupBy("feedback").agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit("log"))
    return counts.unionByName(rejected.groupBy(F.col("score").alias("feedback")).agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit("rejected")))


@query
def config_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer segment's latest written name over the default; empty values keep the default."""
    customers = table(spark, sf_dir, "customer")
    writes = customers.select(F.col("c_mktsegment").alias("key"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("value"), F.col("c_custkey").alias("seq"))
    defaults = customers.select(F.col("c_mktsegment").alias("key")).distinct().unionByName(spark.createDataFrame([("LAST",)], "key string")).withColumn("value", F.lit("default"))
    return logs.effective_config(defaults, logs.latest_config(writes))


@query
def log_rows_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"))
    replies = turns.filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("id"), F.col("text").alias("answer"))
    return logs.exploded_rows(asked.join(replies, "id", "left"))


@query
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.over_limit(table(spark, sf_dir, "events"), REQUESTS_A_DAY, "1 day")


# ---------------------------------------------------------------- graph


@query
def graph_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, nations, regions = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    lives = customers.select(F.col("c_custkey").alias("src"), F.lit("LIVES_IN").alias("rel"), F.col("c_nationkey").alias("dst"))
    part = nations.select(F.col("n_nationkey").alias("src"), F.lit("PART_OF").alias("rel"), F.col("n_regionkey").alias("dst"))
    hops = graph.two_hop(customers, lives, nations, part, regions, ("c_custkey", "n_nationkey", "r_regionkey"))
    return hops.select("c_custkey", "n_name", "r_name")


@query
def graph_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their suppliers in credit and their best customers' segments, both optional."""
    nations, suppliers, customers = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    sells = suppliers.select(F.col("s_nationkey").alias("src"), F.col("s_suppkey").alias("dst"))
    lives = customers.select(F.col("c_nationkey").alias("src"), F.col("c_custkey").alias("dst"))
    in_credit = graph.collected(sells, suppliers, "s_suppkey", "s_name", "suppliers", F.col("s_acctbal") > 5000)
    segments = graph.collected(lives, customers, "c_custkey", "c_mktsegment", "segments", F.col("c_acctbal") > 9000)
    rows = graph.with_optional(graph.with_optional(nations, "n_nationkey", in_credit, "suppliers"), "n_nationkey", segments, "segments")
    return rows.select("n_name", F.array_join("suppliers", ", ").alias("suppliers"), F.array_join("segments", ", ").alias("segments"))


@query
def graph_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.matching(table(spark, sf_dir, "part"), ["p_name", "p_type"], PART_WORDS).select("p_partkey", "p_name", "p_type")


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as titles, their keys' last digit as the plan's state, size as its year and credits."""
    parts = table(spark, sf_dir, "part")
    digit = F.col("p_partkey") % 5
    state = F.when(digit == 0, "Vigente").when(digit == 1, "EnImplantacion").when(digit == 2, "EnExtincion").when(digit == 3, "Extinto").otherwise("Otro")
    # Names are shared by very many parts, so a title is a name and the key's hundred.
    title = F.concat(F.col("p_name"), F.lit(" "), (F.col("p_partkey") % 97).cast("string"))
    return parts.select(title.alias("title"), state.alias("state"), F.col("p_size").alias("year"))


@query
def graph_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.listing(_plans(spark, sf_dir)).select("title", "state", "year", "bucket", "suffix")


@query
def graph_listing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = graph.listing(_plans(spark, sf_dir)).withColumns({"kind": F.lit("Grado"), "ects": F.when(F.col("year") % 2 == 0, F.col("year")), "years": F.lit(4)})
    return graph.listing_text(listed)


@query
def graph_degree_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as degrees, customers as their plans, segments as states, suppliers as options and regions as partners; every row as text."""
    t = {name: table(spark, sf_dir, name) for name in ("nation", "customer", "supplier", "region")}
    node, key = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    share = F.concat(F.lit("d"), (F.col("c_custkey") % 10).cast("string"))
    edge = lambda rows, src, rel, dst: rows.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))
    nation = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    edges = [
        edge(t["customer"], nation, "TIENE_PLAN", key), edge(t["customer"], key, "TIENE_ESTADO", F.col("c_mktsegment")),
        edge(t["customer"].filter("c_custkey % 3 = 0"), key, "TIENE_DISTRIBUCION", share),
        edge(t["supplier"], F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), "OFERTA_MENCION", F.col("s_name")),
        edge(t["nation"].filter("n_nationkey % 2 = 0"), node, "IMPARTE_CON", F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))),
    ]
    every = edges[0]
    for other in edges[1:]:
        every = every.unionByName(other)
    number = F.col("c_custkey") % 10
    tables = {
        "degrees": t["nation"].select(node.alias("code"), F.col("n_name").alias("titulo"), F.lit("Grado").alias("tipo"), F.when(F.col("n_nationkey") % 5 == 0, F.lit("http://x/y")).alias("url")),
        "plans": t["customer"].select(key.alias("plan_code"), F.col("c_name").alias("plan"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 240).alias("ects"), (F.col("c_custkey") % 5).alias("anios"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 50).alias("anio_inicio")),
        "states": t["customer"].select(F.col("c_mktsegment").alias("estado")).distinct().withColumn("descripcion_estado", F.lower("estado")),
        "shares": t["customer"].select(share.alias("share_code"), number.alias("fb"), number.alias("ob"), number.alias("op"), F.when(number != 9, number).alias("pe"), number.alias("tfg")).distinct(),
        "options": t["supplier"].select(F.col("s_name").alias("option_code"), F.col("s_name").alias("option"), (F.col("s_acctbal") > 5000).alias("active")),
        "universities": t["region"].select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("uni_code"), F.col("r_name").alias("university")),
        "edges": every,
    }
    return graph.degree_lookup(tables).select("plan_code", graph.degree_text().alias("text"))


@query
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ask for nations and segments, some for the whole listing; some ask for "it", which what they said before decides."""
    customers, nations, regions = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    about = F.concat(F.lit("about "), F.col("c_mktsegment"), F.lit(" near NATION_"), F.col("c_nationkey").cast("string"))
    asked = customers.select(F.col("c_custkey").alias("question_id"), F.when(F.col("c_custkey") % 4 == 0, "more of it").otherwise(about).alias("question"))
    said = customers.filter("c_custkey % 8 = 0").select(F.col("c_custkey").alias("question_id"), F.concat(F.lit("Usuario: "), about).alias("history"))
    degrees = nations.select(F.col("n_nationkey").alias("place"), F.concat(F.col("n_name"), F.lit(" grado")).alias("haystack"), F.concat(F.lit("D "), F.col("n_name")).alias("text"))
    rules = regions.select(F.col("r_regionkey").alias("place"), F.concat(F.col("r_name"), F.lit(" Building "), F.when(F.col("r_regionkey") % 2 == 0, "nation_1").otherwise("nation_2")).alias("haystack"), F.concat(F.lit("R "), F.col("r_name")).alias("text"))
    plans = nations.select(F.col("n_name").alias("title"), F.lit("Vigente").alias("state"), F.lit(2000).alias("year"), F.lit("Grado").alias("kind"), F.lit(240).alias("ects"), F.lit(4).alias("years"))
    return graph.search(
        asked, degrees, rules, graph.listing_text(graph.listing(plans)), lambda q: models.asks_for_listing(q, SEARCH["listing"]), lambda q: models.entities(q, SEARCH["degrees"], SEARCH["rules"]), "HEAD",
        history=said, rewrite=lambda history, question: F.concat(question, F.lit(" "), history),
    )


@query
def graph_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns of conversations contain which of the longer words of the benchmark."""
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("text_id"), "text")
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("keyword")).filter(F.length("keyword") >= 7).distinct()
    return keywords.containments(turns, words).select("text_id.*", "keyword")


@query
def graph_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as degrees and their lines as plans, by the declared kinds and relations: how many nodes and edges there are of each."""
    made = graph.catalogue(*degrees_of_orders(spark, sf_dir))
    edges = made.pop("edges")
    nodes = graph.count_nodes(**made).select(F.lit("node").alias("kind"), F.col("label").alias("name"), "n")
    return nodes.unionByName(graph.count_edges(edges).select(F.lit("edge").alias("kind"), F.col("rel").alias("name"), "n"))


@query
def graph_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's listing of states."""
    return graph.plan_states(graph.catalogue(*degrees_of_orders(spark, sf_dir)))


@query
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "part", "orders")}
    nodes = graph.count_nodes(**tables).select(F.lit("node").alias("kind"), F.col("label").alias("name"), "n")
    pairs = (("PART_OF", "nation", "n_nationkey", "n_regionkey"), ("LIVES_IN", "customer", "c_custkey", "c_nationkey"), ("SELLS_IN", "supplier", "s_suppkey", "s_nationkey"), ("ORDERED", "orders", "o_custkey", "o_orderkey"))
    edges = None
    for rel, name, src, dst in pairs:
        part = tables[name].select(F.col(src).cast("long").alias("src"), F.lit(rel).alias("rel"), F.col(dst).cast("long").alias("dst"))
        edges = part if edges is None else edges.unionByName(part)
    return nodes.unionByName(graph.count_edges(edges).select(F.lit("edge").alias("kind"), F.col("rel").alias("name"), "n"))


@query
def endpoint_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as edges between customers in credit and orders of some worth."""
    customers, orders = table(spark, sf_dir, "customer").filter("c_acctbal > 0"), table(spark, sf_dir, "orders")
    wanted = orders.select(F.col("o_custkey").alias("src"), F.lit("ORDERED").alias("rel"), F.col("o_orderkey").alias("dst"))
    return graph.merge_edges(wanted, customers, orders.filter("o_totalprice > 1000"), "c_custkey", "o_orderkey")


# ---------------------------------------------------------------- conversations


@query
def history_last6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.last_turns(table(spark, sf_dir, "conversations"), 6)


@query
def history_last4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.last_turns(table(spark, sf_dir, "conversations"), 4, ("user",))


@query
def intent_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    label = F.when(F.col("turn") == 0, "saludo").when(F.col("turn") % 5 == 4, "malicioso")
    asked = turns.withColumn("_r", models.routed(F.when(F.col("turn") % 7 != 6, F.col("text")).otherwise("  "), label))
    return asked.select("conv_id", "turn", "_r.*")


@query
def entity_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.entities(F.col("text"), HINTS["degrees"], HINTS["rules"])
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("_e"))
    return rows.select("conv_id", "turn", F.array_join("_e.degrees", ",").alias("degrees"), F.array_join("_e.rules", ",").alias("rules"), "_e.needs_graph")


# ---------------------------------------------------------------- pages


@query
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.page_title(F.col("html"), F.col("url")).alias("title"))


@query
def page_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of pages; of pages with one name the last stays."""
    named = table(spark, sf_dir, "pages").select("page_id", urls.markdown_name(F.col("url")).alias("name"))
    return named.groupBy("name").agg(F.max("page_id").alias("page_id"), F.count(F.lit(1)).alias("n_pages"))


@query
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.page_links(table(spark, sf_dir, "pages"), before_cleaning=True)


@query
def page_links_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that are left after cleaning, of pages whose menus of even id are no noise; one of the menu's links is commented out."""
    opened = F.when(F.col("page_id") % 2 == 0, F.replace(F.replace("html", F.lit("<nav>"), F.lit("<div>")), F.lit("</nav>"), F.lit("</div>"))).otherwise(F.col("html"))
    commented = F.regexp_replace(opened, '<li><a href="(/[A-Za-z]*)">(.*?)</a></li></ul>', "<!-- <a href=/gone>x</a> --><li><a href=$1>$2</a></li></ul>")
    return text.page_links(table(spark, sf_dir, "pages").withColumn("html", commented))


@query
def page_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strict parser refuses pages whose address has a query or a fragment: how many fail, and of what; the others are parsed."""

    def strict(page: str) -> dict:
        url, html = page.split("\n", 1)
        if "?" in url:
            raise ValueError(f"a query in {url}")
        if "#" in url:
            raise LookupError(f"a fragment in {url}")
        return text.parsed(html)

    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat("url", F.lit("\n"), "html"))
    return isolation.failure_counts(text.page_results(pages, isolation.isolated(strict, text.PARSED)))


@query
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.page_markdown(table(spark, sf_dir, "pages"))


@query
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = text.page_markdown(table(spark, sf_dir, "pages")).withColumnRenamed("url", "source_url")
    return text.chunks(pages, "page_id", "markdown", ("title", "source_url"))


# ---------------------------------------------------------------- texts


@query
def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = text.keep_runs(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_kept", "n_dropped", F.sha2("text", 256).alias("sha256"))


@query
def clean_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a page number, an address and blank lines put in, cleaned again."""
    noisy = F.concat(F.col("text"), F.lit("\n- "), (F.col("doc_id") % 97).cast("string"), F.lit(" -\n\n\n\nend\nhttps://example.org/x\n=====\nlast"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.finish(text.clean_noise(noisy)), 256).alias("sha256"))


@query
def clean_own_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``clean_noise``, with an institution's own lines."""
    noisy = F.concat(F.col("text"), F.lit("\n  ACME institute \n12 Main Street, "), F.col("lang"), F.lit("\nacme,  3 of May\nAcme Institute stays\nlast"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.finish(text.clean_noise(noisy, (*text.NOISE_LINES, *OWN_LINES))), 256).alias("sha256"))


@query
def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as words on the pages of their brand's document, a table's box in each: the lines outside of it."""
    parts = table(spark, sf_dir, "part")
    top = (F.col("p_partkey") % 300 * 3.0).alias("top")
    words = parts.select(F.col("p_brand").alias("doc"), F.col("p_size").alias("page"), F.col("p_name").alias("text"), (F.col("p_partkey") % 7 * 50.0).alias("x"), (F.col("p_partkey") % 7 * 50.0 + 40).alias("x1"), top, (top + 10).alias("bottom"), (F.col("p_partkey") % 5 + 8.0).alias("size"))
    boxes = words.groupBy("doc", "page").agg(F.lit(90.0).alias("x0"), F.lit(240.0).alias("x1"), F.lit(100.0).alias("top"), F.lit(500.0).alias("bottom"))
    return text.word_lines(words, boxes).select("doc", "page", "row", "line", F.round("size", 6).alias("size"), F.round("gap", 6).alias("gap"))


@query
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*text.chunk_lengths(F.char_length("text")))


@query
def font_median_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as lines whose font is their size, headings by their brand's median."""
    parts = table(spark, sf_dir, "part")
    shown = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    medians = parts.groupBy("p_brand").agg(text.upper_median_of("p_size").alias("median"))
    rows = parts.join(medians, "p_brand")
    return rows.select("p_partkey", "median", F.coalesce(text.heading_mark(shown, F.col("p_size").cast("double"), F.col("median")), F.lit("")).alias("mark"))


@query
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's documents as fragments of its prompt, in order of id."""
    docs = table(spark, sf_dir, "documents")
    place = F.row_number().over(Window.partitionBy("source", F.floor(F.col("doc_id") / 100)).orderBy("doc_id"))
    fragments = docs.select(
        F.concat_ws("-", "source", F.floor(F.col("doc_id") / 100).cast("string")).alias("question_id"), place.alias("rank"), "text",
        F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("title"), F.lit(None).cast("string").alias("legacy_title"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source_file"), F.lit("").alias("source"), F.lit(None).cast("string").alias("url"), F.lit(" ").alias("section"),
    )
    return models.prompt_context(fragments).select("question_id", F.sha2("context", 256).alias("sha256"))


@query
def source_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fragments = docs.select(
        F.floor(F.col("doc_id") / 50).alias("question_id"), (F.col("doc_id") % 50).alias("rank"), F.col("lang").alias("title"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.col("source")).alias("url"), F.when(F.col("doc_id") % 8 == 0, F.col("lang")).alias("source_file"),
    )
    return models.distinct_sources(fragments).select("question_id", "source_key", "title", F.col("place").cast("long").alias("place"))


# ---------------------------------------------------------------- evaluation


@query
def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth document as an answer to each of the benchmark's items."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("reference"))
    answers = table(spark, sf_dir, "documents").filter("doc_id % 100 = 0").select("doc_id", F.col("text").alias("answer"))
    return evaluation.overlaps(answers, items, "doc_id", "item_id")


@query
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: of some the server wasn't reached, some have a status, some another message."""
    k = F.col("event_id") % 7
    status = F.when(k == 0, 200).when(k == 1, 404).when(k == 2, 500).when(k == 3, 200)
    message = F.when(k == 3, F.lit(None)).when(k.isin(4, 5), F.concat(F.lit("bad "), F.col("event_type")))
    got = table(spark, sf_dir, "events").select(evaluation.error_class(status, message).alias("_e")).select("_e.*")
    return got.groupBy("error", "has_latency").agg(F.count(F.lit(1)).alias("n"))


@query
def log_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions' times as they are logged and shown, and the seconds since the day's beginning."""
    at = F.col("timestamp")
    return chat_log(spark, sf_dir).select("id", times.iso_format(at).alias("iso"), times.shown_time(at).alias("shown"), times.stamp(at).alias("stamp"), times.elapsed(F.date_trunc("day", at), at).alias("elapsed_s"))


@query
def log_page_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = logs.page_object(chat_log(spark, sf_dir), 3, 7, logs.log_filter(intent="academica", is_safe=True))
    items = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["id"], x["feedback"])), ",")
    return got.select(items.alias("items"), "total", "page", "page_size", "total_pages", "from_row", "to_row")


@query
def feedback_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_user = chat_log(spark, sf_dir).groupBy("user_id").agg(F.avg("feedback").alias("_a"))
    return by_user.select("user_id", logs.feedback_percent(F.col("_a")).alias("shown"))


class _Digests(models.RuleProvider):
    """A model whose answer is the digest of all that it is told."""

    def answer(self, prompt: Column) -> Column:
        return F.sha2(prompt, 256)


@query
def ask_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' user turns as questions, what was said before as their history, documents as fragments; every tenth conversation has graph data."""
    turns = table(spark, sf_dir, "conversations")
    questions = turns.filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "conv_id", "turn", F.when(F.col("conv_id") % 9 == 0, " ").otherwise(F.col("text")).alias("question"),
        F.when(F.col("conv_id") % 11 == 0, "malicioso").alias("label"), F.concat(F.lit("reply to "), F.col("turn").cast("string")).alias("reply"),
    )
    said = models.histories(questions, turns)
    none = F.lit(None).cast("string")
    # Documents go by their number's seventh part to the questions of that conversation.
    fragments = table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 7).alias("conv_id"), (F.col("doc_id") % 7).alias("rank"), F.col("lang").alias("title"), none.alias("legacy_title"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("url"),
        none.alias("source_file"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("source_path"), none.alias("source"), none.alias("section"), "text", (F.col("n_chars") % 100 / 10.0).alias("score"),
    ).join(questions.select("conv_id", "question_id"), "conv_id").drop("conv_id")
    graph_of = questions.filter("conv_id % 10 = 0").select("question_id", F.lit("graph").alias("graph_context"))
    asked = models.ask(questions, fragments, graph_of, provider=_Digests(), history=said, config={"system_prompt": "Be brief.", "model_name": "other"})
    shown = F.array_join(F.transform("sources", lambda x: F.concat(x["title"], F.lit("="), F.coalesce(x["url"], F.lit("-")))), "|")
    numbered = with_ids(asked, "question_id", last_id=100, name="log_id")
    return numbered.select("question_id", "log_id", "intent", "is_safe", "model_name", "answer", (F.col("tokens_used") > 0).alias("has_tokens"), "rerank_score", "error", shown.alias("sources"))


@query
def no_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", evaluation.no_context(F.col("text"), "The Of").alias("no_context"), evaluation.answer_length(F.col("text")).alias("n_words"))


@query
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.run_summary(eval_results(spark, sf_dir))


@query
def eval_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.by_category(eval_results(spark, sf_dir))


@query
def eval_score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.score_stats(judged(spark, sf_dir, "graph"))


@query
def ab_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, better = (evaluation.score_stats(judged(spark, sf_dir, s)) for s in ("plain", "graph"))
    categories = spark.createDataFrame([(c,) for c in ("en", "fr", "de", "es", "xx", evaluation.ALL)], "category string")
    return evaluation.comparison(categories, plain, better)


@query
def critical_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.critical_successes(judged(spark, sf_dir, "plain"), judged(spark, sf_dir, "graph"))


@query
def top_bottom5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.top_and_bottom(judged(spark, sf_dir, "graph")).select("id", "correctness", "list")


@query
def judge_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine, skipped = evaluation.judge_samples(eval_results(spark, sf_dir))
    return skipped.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).unionByName(fine.agg(F.lit("judged").alias("reason"), F.count(F.lit(1)).alias("n")))


@query
def score_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir, "graph").select("id", strings.text_bar(F.col("correctness")).alias("bar"))
