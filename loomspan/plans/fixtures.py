"""The engine's tables as views of the driver's: an interaction log, evaluation results, a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import graph
from loomspan.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logged interactions."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("bigint")
    intent = F.when(kind == "error", "malicioso").when(kind == "signup", "saludo").otherwise("academica")
    academic = intent == "academica"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        "user_id",
        intent.alias("intent"),
        (kind != "error").alias("is_safe"),
        F.when(academic, k).alias("tokens_used"),
        F.when(kind == "purchase", 1).when((kind == "click") & (k % 2 == 0), 0).alias("feedback"),
        F.col("value").alias("rerank_score"),
        F.when(academic, F.lit("model")).otherwise("router").alias("model_name"),
    )


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers: their language is the category, short ones lack context, some failed."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("category"),
        F.when(F.col("doc_id") % 17 != 0, F.col("text")).alias("answer"),
        F.when(F.col("doc_id") % 17 == 0, F.lit("HTTP 500")).alias("error"),
        (F.col("n_chars") < 200).alias("no_context"),
        F.round((F.col("n_chars") % 1000) / 1000.0, 3).alias("overlap"),
    )


def judged(spark: SparkSession, sf_dir: str, system: str) -> DataFrame:
    """Labelled documents as judged answers of one of two systems."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    rows = labels.join(docs, "doc_id")
    part = F.col("n_chars") % 100 / 100.0
    score = F.col("quality") * 0.5 + part * 0.5 if system == "graph" else (F.lit(1) - F.col("toxic")) * 0.4 * part
    return rows.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("category"),
        F.round(score, 4).alias("correctness"),
        F.when(F.col("doc_id") % 7 != 0, F.round(part, 4)).alias("faithfulness"),
    )


def degrees_of_orders(spark: SparkSession, sf_dir: str) -> tuple:
    """Orders as nested rows of a catalogue of degrees, its kinds and relations, and the nodes that are tables of their own.

    An order's lines are its plans, at most some dozen: a third of them have credits, their status is a state and their flag a
    regulation. Every fifth order has a mention; every order's customer stands for a university, of which there are five.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    code = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    number = F.col("l_quantity").cast("int")
    credits = F.when(F.col("l_linenumber") % 3 == 0, F.struct(*[number.alias(c) for c in ("formacion_basica", "obligatorios", "optativos", "practicas_externas", "tfg", "total")]))
    plan = F.struct(
        code.alias("codigo"), code.alias("nombre"), F.year("l_shipdate").alias("anio_inicio"), F.lit(None).cast("string").alias("boe_fecha"), number.alias("plazas"), F.lit(240).alias("ects_total"), F.lit(4).alias("anios_duracion"),
        F.col("l_linestatus").alias("estado"), credits.alias("distribucion"), F.array("l_returnflag").alias("normativa"),
    )
    plans = lines.select("l_orderkey", plan.alias("_p")).groupBy("l_orderkey").agg(F.collect_list("_p").alias("planes"))
    key = F.col("o_orderkey").cast("string")
    mentions = F.when(F.col("o_orderkey") % 5 == 0, F.array(F.struct(F.lit("a b").alias("nombre"), F.lit(True).alias("activa_en_uma"))))
    nested = orders.join(plans, orders["o_orderkey"] == plans["l_orderkey"], "left").select(
        F.concat(F.lit("o"), key).alias("codigo"), F.col("o_orderpriority").alias("nombre"), F.col("o_orderstatus").alias("tipo"), F.lit("").alias("rama"), F.lit(None).cast("string").alias("url"),
        F.lit(False).alias("profesion_regulada"), "planes", mentions.alias("menciones"), F.array((F.col("o_custkey") % 7).cast("string")).alias("co_universidades"),
    )
    others = {
        "ETSI": table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.lit("ETSI-UMA").alias("key")),
        "Estado": orders.select(F.col("o_orderstatus").alias("key")).distinct(),
        "Universidad": table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("key")),
        "Normativa": lines.filter("l_returnflag <> 'N'").select(F.col("l_returnflag").alias("key")).distinct(),
    }
    return materialize(nested, "nested"), graph.DEGREE_KINDS, graph.DEGREE_RELATIONS, others
