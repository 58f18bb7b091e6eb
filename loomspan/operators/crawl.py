"""Following links over a table of landed pages, level by level."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import urls
from loomspan.session import materialize, shared_dir
from loomspan.sources.snapshots import Snapshots

#: Pages visited at most.
MOST_PAGES = 500


def dispatch(url: Column, content_type: Column) -> Column:
    """How a response is taken: a PDF by path or header, a page, or not at all."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(urls.is_pdf(url) | F.contains(kind, F.lit("application/pdf")), "pdf").when(F.contains(kind, F.lit("text/html")), "page").otherwise("skip")


_REACHED = "url string, level int, parent string"
_HASHES = "sha256 string"


def crawl(links: DataFrame, seeds: DataFrame, prefixes: list[str], most_pages: int = MOST_PAGES, state: Snapshots | None = None, until: int | None = None) -> DataFrame:
    """Pages reached from the seeds, breadth first: url, level and the parent that led there first.

    ``links`` has url and link. Only allowed prefixes are followed, no URL is
    visited twice, and the cap is a feature of the operator: within the level
    that reaches it, URLs are taken in order, seeds too. Each level is a version of ``state``, which
    is a store of its own by default. A crawl on a store that has levels goes on from the last; ``until``
    stops it there. A store that can't be read counts as empty.
    """
    spark = links.sparkSession
    state = state or Snapshots(spark, f"{shared_dir(spark)}/loomspan/crawl-{uuid.uuid4().hex}")
    reached = state.load("reached", _REACHED)
    held = reached.agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("level")).first()
    n, level = held["n"], held["level"]
    if level is None:
        first = seeds.select("url").filter("url IS NOT NULL").distinct().orderBy("url").limit(most_pages)
        state.write(reached=first.select("url", F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent")))
        reached, level = state.read("reached", _REACHED), 0
        n = reached.count()
    while n < most_pages and (until is None or level < until):
        further = (
            links.join(reached.filter(F.col("level") == level).select("url"), "url")
            .filter(urls.is_allowed(F.col("link"), prefixes) & ~urls.is_skipped(F.col("link")))
            .groupBy("link")
            .agg(F.min("url").alias("parent"))
            .select(F.col("link").alias("url"), F.lit(level + 1).alias("level"), "parent")
            .join(reached.select("url"), "url", "left_anti")
        )
        state.write(more=True, reached=further.orderBy("url").limit(most_pages - n))
        reached, before, level = state.read("reached", _REACHED), n, level + 1
        n = reached.count()
        if n == before:
            break
    return reached


def new_contents(state: Snapshots, found: DataFrame) -> DataFrame:
    """Of downloaded files (url, sha256) the first by URL of each content that no earlier call has seen; their digests are added to the state."""
    seen = state.load("hashes", _HASHES)
    first = found.filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("url").alias("url")).join(seen, "sha256", "left_anti")
    fresh = materialize(first.select("url", "sha256"), "contents")
    state.write(more=True, hashes=fresh.select("sha256"))
    return fresh


def without_clashes(files: DataFrame, order: str = "pos") -> DataFrame:
    """Files (name, sha256, and their order) with names of their own: of those that share a name the first keeps it, the others
    have the beginning of their digest put before the ending."""
    first = files.groupBy("name").agg(F.min(F.struct(order, "sha256")).alias("_first"))
    stem, ending = F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    other = F.concat(stem, F.lit("_"), F.substring("sha256", 1, 8), ending)
    joined = files.join(first, "name")
    return joined.withColumn("name", F.when(F.struct(order, "sha256") == F.col("_first"), F.col("name")).otherwise(other)).select(*files.columns)


def reset_crawl(state: Snapshots) -> None:
    """Forget pages and contents; the next crawl begins from its seeds."""
    spark = state.spark
    state.reset(reached=spark.createDataFrame([], _REACHED), hashes=spark.createDataFrame([], _HASHES))


def counters(responses: DataFrame) -> DataFrame:
    """Pages read and failed, PDFs new and seen before, over ``kind``, ``error`` and ``content`` hashes."""
    is_pdf = F.col("kind") == "pdf"
    fine = F.col("error").isNull()
    pdfs, distinct = F.count_if(is_pdf & fine), F.count_distinct(F.when(is_pdf & fine, F.col("content")))
    return responses.agg(
        F.count_if((F.col("kind") == "page") & fine).alias("pages"),
        F.count_if(~fine).alias("errors"),
        distinct.alias("new_pdfs"),
        (pdfs - distinct).alias("repeated_pdfs"),
    )


def changed_files(files: DataFrame, manifest: DataFrame, outputs: DataFrame, force: bool = False) -> DataFrame:
    """Files (name, sha256) to convert: those that the manifest lacks with this digest, or whose output is gone."""
    if force:
        return files
    done = manifest.join(outputs.select("name"), "name", "left_semi").select("name", "sha256")
    return files.join(done, ["name", "sha256"], "left_anti")
