"""Model-backed steps behind one interface, and the rules that stand in for the models.

A provider turns columns into columns, so a real model is a pandas UDF and the
rules below are plain expressions. Each rule is what the step falls back to when
no model answers.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import strings
from loomspan.operators.evaluation import keyword_overlap

#: Words that hint at degrees and at regulations, and phrases that ask for a full list.
DEGREE_HINTS = (
    "software", "informática", "computadores", "salud", "ciberseguridad", "inteligencia artificial", "matemáticas", "matematicas",
    "doble grado", "doble", "dgiim", "máster", "master", "doctorado", "itig", "itis", "licenciatura", "ingeniería técnica",
)
RULE_HINTS = (
    "tfg", "tfm", "prácticum", "prácticas externas", "reconocimiento", "permanencia", "reglamento", "extinción", "extinto", "plan antiguo",
)
LISTING_HINTS = (
    "qué grados", "que grados", "cuáles son los grados", "cuales son los grados", "qué titulaciones", "que titulaciones",
    "cuáles son las titulaciones", "qué carreras", "que carreras", "cuáles son las carreras", "grados que", "grados hay",
    "titulaciones hay", "carreras hay", "lista de grados", "listado de grados", "todos los grados", "qué se imparte", "que se imparte",
    "qué ofrece", "que ofrece", "oferta académica", "oferta formativa", "todos los títulos", "todas las titulaciones",
)
#: The reply without any context, the complaint about an empty question, and the graph's name among sources.
NO_CONTEXT = "No dispongo de suficiente contexto para responder a esa pregunta. Prueba a reformularla o consulta con la secretaría de la ETSI Informática."
EMPTY_QUESTION = "La pregunta no puede estar vacía."
GRAPH_SOURCE = "Grafo de Conocimiento ETSI"
#: What stands before the fragments in a prompt, before all context and before the question, and who speaks in a history.
FRAGMENTS_HEADER = (
    "── FRAGMENTOS DE DOCUMENTOS (contexto de apoyo) ──────────────\n"
    "Usa estos fragmentos para complementar la respuesta, pero en caso\n"
    "de contradicción, los DATOS DEL GRAFO tienen prioridad absoluta.\n"
    "───────────────────────────────────────────────────────────────"
)
CONTEXT_LABEL, QUESTION_LABEL = "Contexto relevante:\n\n", "Pregunta del usuario:\n"
SPEAKERS = ("Usuario", "Asistente")
#: Turns that the retriever and the graph look back, and roles that they take for the user's.
RETRIEVER_TURNS, GRAPH_TURNS = 6, 4
RETRIEVER_ROLES, GRAPH_ROLES = ("user", "human"), ("user",)
#: Characters that a question may have.
LONGEST_QUESTION = 1000


class ModelProvider(Protocol):
    """What the engine asks of a model; every answer may be null, for which the caller's rule stands."""

    def embed(self, text: Column) -> Column: ...
    def score(self, question: Column, text: Column) -> Column: ...
    def rewrite(self, history: Column, question: Column) -> Column: ...
    def variations(self, question: Column) -> Column: ...
    def hypothetical(self, question: Column) -> Column: ...
    def answer(self, prompt: Column) -> Column: ...


class RuleProvider:
    """No model: hashed words as vectors, shared words as scores, and no rewriting or answers."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed(self, text: Column) -> Column:
        """Counts of words by hash bucket, scaled to length 1."""
        buckets = F.transform(strings.split_words(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(self.dimensions)))
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.dimensions - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda t, x: t + x * x))
        return F.transform(counts, lambda x: x / F.greatest(norm, F.lit(1e-12)))

    def score(self, question: Column, text: Column) -> Column:
        return keyword_overlap(question, text)

    def rewrite(self, history: Column, question: Column) -> Column:
        return question

    def variations(self, question: Column) -> Column:
        return F.array().cast("array<string>")

    def hypothetical(self, question: Column) -> Column:
        return F.lit("")

    def answer(self, prompt: Column) -> Column:
        return F.lit(None).cast("string")


def valid_question(question: Column) -> Column:
    return F.coalesce(F.char_length(strings.strip(question)).between(1, LONGEST_QUESTION), F.lit(False))


def routed(question: Column, label: Column | None = None, safe: Column | None = None) -> Column:
    """The router's answer as a struct: intent, is_safe, proceed and blocked.

    Blank questions are greetings; without a model's label a question is academic.
    """
    label = F.lit(None).cast("string") if label is None else label
    safe = F.lit(None).cast("boolean") if safe is None else safe
    blank = F.coalesce(strings.strip(question), F.lit("")) == ""
    bad = ~F.coalesce(safe, F.lit(True)) | F.coalesce(label == "malicioso", F.lit(False))
    intent = F.when(blank, "saludo").when(bad, "malicioso").when(label == "saludo", "saludo").otherwise("academica")
    return F.struct(intent.alias("intent"), (blank | ~bad).alias("is_safe"), (intent == "academica").alias("proceed"), (bad & ~blank).alias("blocked"))


def entities(question: Column, degree_hints: Sequence[str] = DEGREE_HINTS, rule_hints: Sequence[str] = RULE_HINTS) -> Column:
    """Keyword lists found in a question and whether the graph is needed at all."""
    degrees, rules = strings.contained(question, list(degree_hints)), strings.contained(question, list(rule_hints))
    return F.struct(degrees.alias("degrees"), rules.alias("rules"), ((F.size(degrees) > 0) | (F.size(rules) > 0)).alias("needs_graph"))


def asks_for_listing(question: Column, hints: Sequence[str] = LISTING_HINTS) -> Column:
    return F.size(strings.contained(question, list(hints))) > 0


def query_pool(question: Column, variations: Column, hypothetical: Column) -> Column:
    """The queries of a question in order: itself, at most three variations, a hypothetical answer if given."""
    last = F.when(F.coalesce(hypothetical, F.lit("")) != "", F.array(hypothetical)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(question), F.slice(F.coalesce(variations, F.array().cast("array<string>")), 1, 3), last)


def variation_lines(reply: Column, most: int = 3) -> Column:
    """The first lines of a model's reply that aren't blank."""
    kept = F.filter(F.transform(strings.split_lines(reply), strings.strip), lambda x: x != "")
    return F.slice(kept, 1, most)


def last_turns(conversations: DataFrame, n: int, user_roles: Sequence[str] = ("user", "human")) -> DataFrame:
    """The last ``n`` turns of each conversation in order, marked as the user's or the assistant's."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    speaker = F.when(F.col("role").isin(*user_roles), "user").otherwise("assistant")
    kept = conversations.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n)
    return kept.select("conv_id", "turn", speaker.alias("speaker"), "text")


def prompt_context(fragments: DataFrame, key: str = "question_id") -> DataFrame:
    """Fragments of a question in order, each under a header of what is known of it."""
    c = F.col
    title, source = strings.first_given(c("title"), c("legacy_title")), strings.first_given(c("source_file"), c("source"), c("url"))
    header = F.concat_ws(
        " | ",
        F.concat(F.lit("Documento: "), title),
        F.concat(F.lit("Fuente: "), source),
        F.concat(F.lit("Sección: "), F.nullif(strings.strip(c("section")), F.lit(""))),
    )
    shown = F.when(header != "", header).otherwise(F.concat(F.lit("Fragmento "), c("rank")))
    block = F.concat(F.lit("["), shown, F.lit("]\n"), F.coalesce(c("text"), F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return fragments.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n---\n\n").alias("context"))


def histories(questions: DataFrame, turns: DataFrame, n: int = RETRIEVER_TURNS, user_roles: Sequence[str] = RETRIEVER_ROLES) -> DataFrame:
    """What was said before each question: question_id and ``history``, a line for each of the last ``n`` turns, in order.

    ``questions`` has question_id, conv_id and turn; ``turns`` conv_id, turn, role and text. It is a join as of the question's
    turn: of the turns before it the last ``n`` count, its own and later ones don't. Without any the history is empty. Every turn
    carries the ``n`` up to it, so that a question takes one row, and no conversation is collected.
    """
    speaker = F.when(F.col("role").isin(*user_roles), SPEAKERS[0]).otherwise(SPEAKERS[1])
    line = F.concat(speaker, F.lit(": "), F.coalesce("text", F.lit("")))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "_line")
    said = turns.select("conv_id", "turn", line.alias("_line"))
    held = said.select("conv_id", "turn", F.collect_list("_line").over(in_order.rowsBetween(1 - n, 0)).alias("_lines"), F.lit(1).alias("_kind"), F.lit(None).cast(questions.schema["question_id"].dataType).alias("question_id"))
    asked = questions.select("conv_id", "turn", F.lit(None).cast("array<string>").alias("_lines"), F.lit(0).alias("_kind"), "question_id")
    before = Window.partitionBy("conv_id").orderBy("turn", "_kind", F.size(F.coalesce("_lines", F.array().cast("array<string>")))).rowsBetween(Window.unboundedPreceding, 0)
    found = held.unionByName(asked).withColumn("_last", F.last("_lines", ignorenulls=True).over(before)).filter("_kind = 0")
    return found.select("question_id", F.coalesce(F.array_join("_last", "\n"), F.lit("")).alias("history"))


def rewritten(questions: DataFrame, history: DataFrame | None, rewrite: Callable[[Column, Column], Column] | None) -> DataFrame:
    """Questions made to stand alone by what was said before; those without history, or with an empty result, as they are."""
    if history is None or rewrite is None:
        return questions
    joined = questions.join(history.select("question_id", "history"), "question_id", "left")
    new = strings.first_given(strings.strip(rewrite(F.col("history"), F.col("question"))), F.col("question"))
    return joined.withColumn("question", F.when(F.coalesce("history", F.lit("")) != "", new).otherwise(F.col("question"))).drop("history")


def full_prompt(graph: Column, documents: Column) -> Column:
    """The graph's block before the documents', these under their header; either may be null."""
    return F.concat_ws("\n\n", graph, F.concat(F.lit(FRAGMENTS_HEADER + "\n\n"), documents))


def messages(system: Column, history: Column, context: Column, question: Column) -> Column:
    """All that a model is told, in order: the system's prompt, the history, the context and the question."""
    asked = F.concat(F.lit(CONTEXT_LABEL), context, F.lit("\n\n" + QUESTION_LABEL), question)
    return F.concat_ws("\n\n", F.nullif(system, F.lit("")), F.nullif(history, F.lit("")), asked)


def _given(rows: DataFrame, *names: str) -> Column:
    """The first of the named columns that is given, of those that there are."""
    there = [F.col(n) for n in names if n in rows.columns]
    return strings.first_given(*there) if there else F.lit(None).cast("string")


def distinct_sources(fragments: DataFrame, key: str = "question_id") -> DataFrame:
    """Each question's sources, first seen first: source_key, title, url and place; fragments without one are left out.

    A source's address is in ``source_url``, ``url`` or ``source``, its file in ``source_file``, ``source_path`` or ``source``, its
    title in ``title`` or ``legacy_title``: the first that is given counts, and columns may be absent. The address, else the file, tells sources apart.
    """
    address, file = _given(fragments, "source_url", "url", "source"), _given(fragments, "source_file", "source_path", "source")
    shown = F.struct(F.coalesce(_given(fragments, "title", "legacy_title"), F.lit("")).alias("title"), address.alias("url"))
    keyed = fragments.select(key, "rank", F.coalesce(address, file).alias("source_key"), shown.alias("_s")).filter(F.col("source_key").isNotNull())
    first = keyed.groupBy(key, "source_key").agg(F.min_by("_s", "rank").alias("_s"), F.min("rank").alias("_rank"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_rank", "source_key"))
    return first.select(key, "source_key", "_s.title", "_s.url", place.alias("place"))


def ask_outcome(proceed: Column, has_context: Column, answer: Column, tokens: Column, score: Column, model: str) -> Column:
    """What is logged for a question: the router's reply, no context, or an answer; only the last has tokens and score."""
    name = F.when(~proceed, "router").when(~has_context, "none").otherwise(model)
    logged = proceed & has_context
    return F.struct(name.alias("model_name"), F.when(logged, answer).alias("answer"), F.when(logged, tokens).alias("tokens_used"), F.when(logged, score).alias("rerank_score"))


def answered(question: Column, fragments: Column, graph: Column, answer: Column, tokens: Column) -> Column:
    """An answer as a struct: ``error`` for an empty question, a fixed apology of no tokens without any context, else the model's."""
    empty = F.coalesce(question, F.lit("")) == ""
    bare = (F.coalesce(fragments, F.lit("")) == "") & (F.coalesce(graph, F.lit("")) == "")
    return F.struct(
        F.when(empty, EMPTY_QUESTION).alias("error"),
        F.when(~empty, F.when(bare, NO_CONTEXT).otherwise(answer)).alias("answer"),
        F.when(~empty, F.when(bare, 0).otherwise(tokens)).cast("long").alias("tokens_used"),
    )


def ask(
    questions: DataFrame,
    fragments: DataFrame,
    graph_of: DataFrame,
    model: str = "model",
    provider: ModelProvider | None = None,
    history: DataFrame | None = None,
    config: Mapping[str, str | None] | None = None,
    system_prompt: str = "",
) -> DataFrame:
    """One row per question as it is logged, with the sources to show.

    ``questions`` has question_id, question, and of the router's model label, safe and ``reply`` (all nullable; the last two may be
    absent); ``fragments`` what ``prompt_context`` and ``distinct_sources`` take, with a score; ``graph_of`` question_id and graph_context;
    ``history`` question_id and history; ``config`` overrides ``system_prompt`` and, in what the provider is asked by, ``model_name``. A question that is not
    let through gets no lookups and is logged with the router's reply under the router's name; one without context gets the apology under none;
    the others the provider's answer under ``model``, which stays the logged name where the configuration has another, with tokens (words of prompt and answer)
    and best score. Sources are title and url, the graph first; an empty question that the router lets through has ``error``.
    """
    provider, config = RuleProvider() if provider is None else provider, config or {}
    safe, reply = (F.col(c) if c in questions.columns else F.lit(None) for c in ("safe", "reply"))
    routes = questions.select("question_id", "question", routed(F.col("question"), F.col("label"), safe.cast("boolean")).alias("_route"), reply.cast("string").alias("_reply"))
    through = routes.filter("_route.proceed").select("question_id")
    wanted = fragments.join(through, "question_id", "left_semi")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "title", "url"))), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url")))
    shown = distinct_sources(wanted).groupBy("question_id").agg(ordered.alias("_sources"))
    best = wanted.groupBy("question_id").agg(F.max("score").alias("_score"))
    rows = routes
    for other in (prompt_context(wanted), graph_of.join(through, "question_id", "left_semi"), shown, best):
        rows = rows.join(other, "question_id", "left")
    rows = rows.withColumn("history", F.lit("")) if history is None else rows.join(history.select("question_id", "history"), "question_id", "left")
    prompt = messages(F.lit(config.get("system_prompt") or system_prompt), F.col("history"), full_prompt(F.col("graph_context"), F.col("context")), F.col("question"))
    rows = rows.withColumn("_prompt", prompt)
    named = config.get("model_name")
    answer = provider.answer(F.concat(F.lit(f"[{named}] "), F.col("_prompt"))) if named and named != model else provider.answer(F.col("_prompt"))
    rows = rows.withColumn("_answer", F.coalesce(answer, F.lit("")))
    words = (F.size(strings.split_words(F.col("_prompt"))) + F.size(strings.split_words(F.col("_answer")))).cast("long")
    proceed = F.col("_route.proceed")
    has_context = F.col("context").isNotNull() | F.col("graph_context").isNotNull()
    out = answered(F.col("question"), F.col("context"), F.col("graph_context"), F.col("_answer"), words)
    none = F.array().cast("array<struct<title:string,url:string>>")
    from_graph = F.array(F.struct(F.lit(GRAPH_SOURCE).alias("title"), F.lit(None).cast("string").alias("url")))
    sources = F.concat(F.when(F.col("graph_context").isNotNull(), from_graph).otherwise(none), F.coalesce("_sources", none))
    outcome = ask_outcome(proceed, has_context, F.col("_out.answer"), F.col("_out.tokens_used"), F.col("_score"), model)
    return rows.withColumn("_out", out).withColumn("_logged", outcome).select(
        "question_id",
        "question",
        F.col("_route.intent").alias("intent"),
        F.col("_route.is_safe").alias("is_safe"),
        "_logged.model_name",
        F.when(~proceed, F.col("_reply")).otherwise(F.col("_out.answer")).alias("answer"),
        "_logged.tokens_used",
        "_logged.rerank_score",
        F.when(proceed, F.col("_out.error")).alias("error"),
        F.when(proceed & has_context, sources).otherwise(none).alias("sources"),
    )


def shown_sources(sources: DataFrame) -> DataFrame:
    """Sources with anything to show: a title or an address."""
    return sources.filter((F.coalesce("title", F.lit("")) != "") | (F.coalesce("url", F.lit("")) != ""))
