"""Sources as DataFrames: text files, JSON maps and lists, tables over JDBC, and collections."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.strings import first_given
from loomspan.operators.isolation import isolated
from loomspan.sources.snapshots import Snapshots


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each Markdown file of a folder as one row, hidden ones left out: name and text, by name."""
    read = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    named = read.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return named.filter(~F.startswith("name", F.lit("."))).orderBy("name")


def binary_files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """Files with their bytes' digest, for conversion by whatever reads them."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return read.select(F.col("_metadata.file_name").alias("name"), F.sha2("content", 256).alias("sha256"), "content")


_PAGES = (
    "array<struct<page:int,words:array<struct<text:string,x:double,x1:double,top:double,bottom:double,size:double>>,"
    "tables:array<struct<x0:double,x1:double,top:double,bottom:double,rows:array<array<string>>>>>>"
)


def _pages(content: bytes) -> list[dict]:
    """A landed document's pages: its words, with their size or none, and its tables with their boxes and cells."""
    given = lambda x, *names: {n: float(x[n]) for n in names}
    pages = []
    for i, page in enumerate(json.loads(content)["pages"], 1):
        words = [{"text": w["text"], "x": float(w["x0"]), "size": None if w.get("size") is None else float(w["size"]), **given(w, "x1", "top", "bottom")} for w in page.get("words") or []]
        tables = [{**given(t, "x0", "x1", "top", "bottom"), "rows": [[None if c is None else str(c) for c in r] for r in t["rows"]]} for t in page.get("tables") or []]
        pages.append({"page": i, "words": words, "tables": tables})
    return pages


def page_words(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """Landed documents (a JSON file each: ``pages``, each with ``words`` of text, x0, x1, top, bottom, size, and ``tables`` of a box
    and rows) as ``doc`` (the file's stem), ``sha256``, ``pages`` and ``error``.

    A file that can't be read as such is a row with an error. Files are split over tasks by size, and read by whatever store they are in.
    """
    files = binary_files(spark, folder, glob)
    parsed = files.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("doc"), "sha256", isolated(_pages, _PAGES)(F.col("content")).alias("_r"))
    return parsed.select("doc", "sha256", F.col("_r.value").alias("pages"), F.col("_r.error").alias("error"))


def words_of(documents: DataFrame) -> DataFrame:
    """The words of ``page_words``: doc, page, text, x, x1, top, bottom, size."""
    return documents.select("doc", F.explode("pages").alias("_p")).select("doc", "_p.page", F.explode("_p.words").alias("_w")).select("doc", "page", "_w.*")


def tables_of(documents: DataFrame) -> DataFrame:
    """The tables of ``page_words``: doc, page, the box, and rows."""
    return documents.select("doc", F.explode("pages").alias("_p")).select("doc", "_p.page", F.explode("_p.tables").alias("_t")).select("doc", "page", "_t.*")


def boxes_of(documents: DataFrame) -> DataFrame:
    return tables_of(documents).drop("rows")


def url_maps(spark: SparkSession, pdf_map: str | None, web_map: str | None) -> DataFrame:
    """File name and URL from two JSON objects; the second, of plain strings, overrides the first."""
    value = T.MapType(T.StringType(), T.StringType())
    found = None
    for order, path in enumerate((pdf_map, web_map)):
        if path is None:
            continue
        whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", value)).alias("name", "_v"))
        is_object = F.startswith(F.ltrim("_v"), F.lit("{"))
        url = F.coalesce(F.get_json_object("_v", "$.source_url"), F.lit("")) if order == 0 else F.col("_v")
        rows = whole.filter(is_object if order == 0 else ~is_object).select("name", url.alias("url"), F.lit(order).alias("_o"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], "name string, url string")
    return found.groupBy("name").agg(F.max_by("url", "_o").alias("url"))


def with_url(files: DataFrame, urls: DataFrame) -> DataFrame:
    """Files with the URL known for the PDF of the same stem, else for the file, else none."""
    stem = F.regexp_replace("name", r"\.md$", "")
    a = urls.select(F.col("name").alias("_a"), F.col("url").alias("_ua"))
    b = urls.select(F.col("name").alias("_b"), F.col("url").alias("_ub"))
    joined = files.join(a, F.concat(stem, F.lit(".pdf")) == F.col("_a"), "left").join(b, files["name"] == F.col("_b"), "left")
    return joined.withColumn("source_url", first_given(F.col("_ua"), F.col("_ub"), F.lit(""))).withColumn("source_url", F.coalesce("source_url", F.lit(""))).drop("_a", "_ua", "_b", "_ub")


def eval_items(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set: a JSON list; a missing id is the 1-based place, a missing category "unknown"."""
    item = "struct<id:string,category:string,question:string,ground_truth:string>"
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", f"array<{item}>")).alias("pos", "_i"))
    return rows.select(
        "pos",
        F.coalesce("_i.id", (F.col("pos") + 1).cast("string")).alias("id"),
        F.coalesce("_i.category", F.lit("unknown")).alias("category"),
        F.col("_i.question").alias("question"),
        F.col("_i.ground_truth").alias("ground_truth"),
    )


RESULT = (
    "struct<id:string,category:string,question:string,ground_truth:string,answer:string,sources:array<struct<title:string,url:string>>,"
    "log_id:bigint,metrics:struct<no_context_response:boolean,keyword_overlap:double,answer_length_words:int,latency_seconds:double>,"
    "ragas:struct<faithfulness:double,answer_relevancy:double,context_recall:double,context_precision:double>,error:string>"
)


def eval_results(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation results: a JSON list, or an object that has one under "results"."""
    whole = spark.read.text(path, wholetext=True)
    listed = F.startswith(F.ltrim("value"), F.lit("["))
    results = F.when(listed, F.col("value")).otherwise(F.get_json_object("value", "$.results"))
    return whole.select(F.posexplode(F.from_json(results, f"array<{RESULT}>")).alias("pos", "_r")).select("pos", "_r.*")


def selected(items: DataFrame, category: str | None = None, limit: int | None = None) -> DataFrame:
    """Items of a category, of these the first ``limit`` in order."""
    kept = items.filter(F.col("category") == category) if category else items
    return kept.orderBy("pos").limit(limit) if limit is not None else kept


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a relational database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def log_rows(spark: SparkSession, path: str) -> DataFrame:
    """An interaction log of any age: columns added later are null in older files."""
    read = spark.read.option("mergeSchema", "true").parquet(path)
    for name, kind in (("rerank_score", "double"), ("feedback", "int"), ("tokens_used", "int")):
        if name not in read.columns:
            read = read.withColumn(name, F.lit(None).cast(kind))
    return read


def collection(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored collection's last version, empty where none has been written yet."""
    return Snapshots(spark, path).read("rows", schema)


def graph(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """Nodes of a label, or the edges, of a stored graph's last version."""
    store = Snapshots(spark, path)
    name = "edges" if label is None else f"nodes_{label}"
    return store.read(name, store.schema(name))
