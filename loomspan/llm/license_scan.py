"""Licence scan by a positional index of rare tokens.

The templates' words are indexed by template and position, all but the most
common ones. A file looks up every indexed word it holds, at most as many as the
templates have; every posting
votes for a template at the place where the template would have to begin, so
votes that agree on a place show the template's words standing in the template's
order and spacing. A template that gathers enough of its weight at one place
becomes a label if the file also has the template's mandatory key phrases.

All of it is DataFrame functions: splitting, an array overlap that sends most
files past the index, a join with the index, and aggregation of votes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import WORD, lower_ascii, row_key, text_or_empty, words
from loomspan.session import materialize

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Labels and the words of their identifiers after "SPDX-License-Identifier:".
SPDX = {
    "agpl-3": "agpl 3 0", "apache-2.0": "apache 2 0", "bsd": "bsd", "cc-by-4.0": "cc by 4 0", "cc-by-nc-4.0": "cc by nc 4 0", "cc-by-sa-4.0": "cc by sa 4 0",
    "gpl-2": "gpl 2 0", "gpl-3": "gpl 3 0", "lgpl-3": "lgpl 3 0", "mit": "mit", "mpl-2.0": "mpl 2 0", "unlicense": "unlicense",
}

#: Label -> opening words of a public licence or of its usual notice, and its mandatory key phrases. What follows a "#" is no part of the label.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "agpl-3": ("this work is licensed under the gnu affero general public license version 3", ("affero general public license",)),
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license", "version 2")),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "binary forms")),
    "cc-by-4.0": ("this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ("cc by sa",)),
    "gpl-2": ("this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    "gpl-3": ("this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    "lgpl-3": ("this work is licensed under the gnu lesser general public license version 3", ("lesser general public license",)),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    "mit-notice": ("released under the mit license", ("mit license",)),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "proprietary": ("all rights reserved no part of this publication may be reproduced or distributed in any form without the prior written permission of the publisher", ("all rights reserved", "no part of")),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    **{f"{label}#spdx": (f"spdx license identifier {name}", (f"spdx license identifier {name}",)) for label, name in SPDX.items()},
}

#: Words too common in any text to be worth a posting.
COMMON = frozenset("a and any are be by for form from in is it may met no of on or part that the this to use with 0 2 3 4".split())
#: A template needs this share of its weight at one place.
ENOUGH = 0.6


def template_index(templates: dict[str, tuple[str, tuple[str, ...]]]) -> tuple[list[tuple[str, str, int, float]], dict[str, float]]:
    """Postings (word, label, position, idf) of the rarer words, and each template's total weight."""
    split = {label: re.findall(WORD, text) for label, (text, _) in templates.items()}
    seen = Counter(w for ws in split.values() for w in set(ws))
    idf = {w: math.log(1 + len(split) / n) for w, n in seen.items() if w not in COMMON}
    postings = [(w, label, i, idf[w]) for label, ws in split.items() for i, w in enumerate(ws) if w in idf]
    total: dict[str, float] = {}
    for _, label, _, weight in postings:
        total[label] = total.get(label, 0.0) + weight
    return postings, total


def phrase_starts(text_words: Column, phrase: str) -> Column:
    """Positions, from 0, at which the phrase's words stand consecutively."""
    parts = phrase.split(" ")
    indices = F.sequence(F.lit(0), F.size(text_words) - len(parts))

    def here(i: Column) -> Column:
        found = F.get(text_words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found = found & (F.get(text_words, i + k) == part)
        return found

    possible = F.array_contains(text_words, parts[-1]) & (F.size(text_words) >= len(parts))
    return F.when(possible, F.filter(indices, here)).otherwise(F.array().cast("array<int>"))


def scan(
    docs: DataFrame,
    templates: dict[str, tuple[str, tuple[str, ...]]] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: word count, places of the base phrases, labels and a score.

    A null text is empty: no words, no labels, score 0. Rows that repeat an id
    and text get equal results; a null id stays null; columns other than id and
    text are not kept; an empty table gives an empty result. A text of any length is read whole. ``score`` is the
    greatest share of a template's weight found at one place, 1 where a base
    phrase stands. The index is as large as the templates, an argument that a
    caller writes down, so it is broadcast.
    """
    templates = TEMPLATES if templates is None else templates
    postings, total = template_index(templates)
    keyed = row_key(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("_text")), "doc_id", "_text")
    rows = materialize(_looked_up(keyed, templates, postings), "licence")
    index = docs.sparkSession.createDataFrame(
        [(w, label, i, weight / total[label]) for w, label, i, weight in postings],
        "_word string, _label string, _at int, _share double",
    )
    votes = (
        rows.select("_k1", "_k2", "_verified", F.explode("_hits").alias("_hit"))
        .select("_k1", "_k2", "_verified", F.col("_hit.word").alias("_word"), F.col("_hit.pos").alias("_pos"))
        .join(F.broadcast(index), "_word")
        .filter(F.array_contains("_verified", F.col("_label")))
        .groupBy("_k1", "_k2", "_label", (F.col("_pos") - F.col("_at")).alias("_start"))
        .agg(F.collect_set(F.struct("_at", "_share")).alias("_votes"))  # at most one per word of the template
    )
    share = F.aggregate("_votes", F.lit(0.0), lambda total, v: total + v["_share"])
    labelled = (
        votes.withColumn("_share", share)
        .filter(F.col("_share") >= ENOUGH)
        .groupBy("_k1", "_k2")
        .agg(F.collect_set(F.substring_index("_label", "#", 1)).alias("_labels"), F.max("_share").alias("_score"))
    )
    has_base = F.size("_base") > 0
    every = F.array_union("_base", F.coalesce("_labels", F.array().cast("array<string>")))
    score = F.when(has_base, 1.0).when(F.col("_score").isNotNull(), F.least(F.round("_score", 6), F.lit(1.0))).otherwise(0.0)
    return rows.join(labelled, ["_k1", "_k2"], "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        score.alias("score"),
    )


def _looked_up(keyed: DataFrame, templates: dict, postings: list[tuple[str, str, int, float]]) -> DataFrame:
    """One pass over the texts: counts, base phrases, and where the licence words stand."""
    indexed = sorted({w for w, _, _, _ in postings})
    lookup = F.array(*map(F.lit, indexed))
    telling = F.array(*map(F.lit, sorted({*indexed, *(phrase.rsplit(" ", 1)[1] for phrase, _ in BASE)})))
    none = F.array().cast("array<int>")
    split = keyed.select("doc_id", "_k1", "_k2", words(lower_ascii(text_or_empty("_text"))).alias("_words"))
    hinted = split.withColumn("_hint", F.arrays_overlap("_words", telling))
    joined = F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))
    flat = hinted.withColumns(
        {
            "_flat": F.when(F.col("_hint"), joined),
            "_looked": F.when(F.col("_hint"), F.array_intersect(lookup, "_words")),
            **{f"_b{i}": F.when(F.col("_hint"), phrase_starts(F.col("_words"), p)).otherwise(none) for i, (p, _) in enumerate(BASE)},
        }
    )
    verified = F.array_compact(
        F.array(
            *[
                F.when(reduce(and_, [F.contains("_flat", F.lit(f" {p} ")) for p in phrases]), F.lit(label))
                for label, (_, phrases) in templates.items()
            ]
        )
    )
    placed = F.transform("_words", lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
    hits = F.filter(placed, lambda x: F.array_contains("_looked", x["word"]))
    starts = F.concat(*[f"_b{i}" for i in range(len(BASE))])
    base = F.array_compact(F.array(*[F.when(F.size(f"_b{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    wanted = F.col("_hint") & (F.size("_verified") > 0)
    return flat.withColumn("_verified", F.when(F.col("_hint"), verified)).select(
        "doc_id",
        "_k1",
        "_k2",
        F.size("_words").cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_distinct(base).alias("_base"),
        "_verified",
        F.when(wanted, hits).alias("_hits"),
    )
