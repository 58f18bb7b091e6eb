"""The queries of the corpus operators, with production parameters, and their SQL where there is any.

Each query applies its operator to the whole of its table and derives the
columns of the result from what the operator gives.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import bpe, conversation_trie, decontaminate, exact_dedup, license_scan, line_dedup, merkle, near_dup, pii, quality, quality_rules, sharding, toxicity

#: The vocabulary file that op10 and the pipeline use.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_read(spark, sf_dir, "documents"), n_shards=40)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.remove_boilerplate(_read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = decontaminate.find_matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return decontaminate.digest(matches).drop("n_near_items")


def op6_pii_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = pii.train(pii.labelled_table(spark))
    return pii.digest(pii.find_pii(_read(spark, sf_dir, "documents"), field))


def op7_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op8_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op9_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op10_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), VOCABULARY)


def op11_rollup_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.turns_of(_read(spark, sf_dir, "conversations"))
    return conversation_trie.digest(*conversation_trie.prefix_trie(*conversation_trie.rebuilt(turns)))


def op12_cogrouped_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.without_newlines(F.col("doc_id"), F.col("text")))


def op13_ngram_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return quality_rules.rules(docs, quality_rules.fit(docs, quality_rules.trusted_ids(labels)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_index": op1_license_index,
    "op2_kd_shards": op2_kd_shards,
    "op3_order_minhash": op3_order_minhash,
    "op4_site_spread": op4_site_spread,
    "op5_positional_index": op5_positional_index,
    "op6_pii_field": op6_pii_field,
    "op7_factorization_machine": op7_factorization_machine,
    "op8_chunk_recipes": op8_chunk_recipes,
    "op9_boosted_trees": op9_boosted_trees,
    "op10_bpe_transducer": op10_bpe_transducer,
    "op11_rollup_trie": op11_rollup_trie,
    "op12_cogrouped_merkle": op12_cogrouped_merkle,
    "op13_ngram_likelihood": op13_ngram_likelihood,
}

def _crc32(decimal: str) -> str:
    """crc32 of a number's decimal form, in SQL: eight shifts for each character."""
    shifts = "[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]"
    steps = f"flatten(list_transform(string_split(CAST({decimal} AS VARCHAR), ''), lambda c: CAST({shifts} AS BIGINT[])))"
    fold = "CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda a, x: {fold}), 4294967295)"


def _leaf(text: str) -> str:
    part = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + ")"


ORACLES: dict[str, str] = {
    "op4_site_spread": """
        WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
                          unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
             b AS (SELECT trim(line, ' ') AS line, arg_min(doc_id, (doc_id, pos)) AS first_doc, arg_min(pos, (doc_id, pos)) AS first_pos
                   FROM l WHERE length(trim(line, ' ')) >= 8 GROUP BY trim(line, ' ') HAVING count(DISTINCT site) >= 8),
             k AS (SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AND (l.doc_id, l.pos) <> (b.first_doc, b.first_pos) AS gone
                   FROM l LEFT JOIN b ON trim(l.line, ' ') = b.line),
             r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
                          coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM k GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS text_sha256
        FROM documents d LEFT JOIN r USING (doc_id)
    """,
    "op5_positional_index": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
             b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
             bk AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0),
             bw AS (SELECT DISTINCT item_id, k, array_to_string(ws[i + 1:i + k], ' ') AS win
                    FROM (SELECT item_id, ws, k, unnest(range(len(ws) - k + 1)) AS i FROM bk)),
             dw AS (SELECT doc_id, k, i, array_to_string(ws[i + 1:i + k], ' ') AS win
                    FROM (SELECT doc_id, ws, k, unnest(range(len(ws) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k)),
             h AS (SELECT doc_id, item_id, i, dw.k AS k FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
             n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
             s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                   FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
    """,
    "op8_chunk_recipes": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
        FROM t JOIN g USING (norm)
    """,
    "op11_rollup_trie": rf"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
                   FROM conversations WHERE conv_id IS NOT NULL),
             c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
             r AS (SELECT c.conv_id, 0 AS part, place, role, text FROM c JOIN t ON t.conv_id = c.base AND place < h
                   UNION ALL SELECT c.conv_id, 1, place, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND place >= h),
             p AS (SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY part, place) FILTER (part IS NOT NULL), []) AS path
                   FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
             m AS (SELECT conv_id, len(path) AS n, unnest(range(len(path) + 1)) AS depth, path FROM p),
             n AS (SELECT depth, path[1:depth] AS node, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS longest,
                          coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends
                   FROM m GROUP BY depth, path[1:depth]),
             v AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(node[depth].text, '[^\x20\x09-\x0D]+')) END AS saved FROM n),
             u AS (SELECT d AS depth, node[1:d] AS node, sum(saved) AS saved_tokens, count(*) FILTER (longest = depth) AS n_leaves, count(*) FILTER (depth = d + 1) AS n_children
                   FROM (SELECT *, unnest(range(depth + 1)) AS d FROM v) GROUP BY d, node[1:d])
        SELECT v.conv_id, v.depth, o.conv_id AS parent_conv_id, v.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
        FROM v JOIN u ON v.depth = u.depth AND v.node = u.node LEFT JOIN n o ON o.depth = v.depth - 1 AND o.node = v.node[1:v.depth - 1]
    """,
    "op12_cogrouped_merkle": rf"""
        WITH RECURSIVE
             d AS (SELECT doc_id, source,
                          {_leaf("text")} AS leaf,
                          CASE WHEN {_crc32("doc_id")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS tampered FROM documents),
             s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS tree FROM (SELECT DISTINCT source FROM d)),
             l AS (SELECT doc_id, leaf, tampered, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
             g AS (SELECT tree, 0 AS level, place, leaf AS hash, count(*) OVER (PARTITION BY tree) AS size FROM l
                   UNION ALL SELECT tree, level + 1, place // 3, sha256(string_agg(hash, '' ORDER BY place)), (max(size) + 2) // 3 FROM g WHERE size > 1 GROUP BY tree, level, place // 3),
             t AS (SELECT tree, hash AS subroot, level AS height FROM g WHERE size = 1),
             o AS (SELECT 0 AS level, tree - 1 AS place, subroot AS hash, count(*) OVER () AS size FROM t
                   UNION ALL SELECT level + 1, place // 3, sha256(string_agg(hash, '' ORDER BY place)), (max(size) + 2) // 3 FROM o WHERE size > 1 GROUP BY level, place // 3),
             e AS (SELECT tree, level, place, hash FROM g WHERE size > 1 UNION ALL SELECT 0, level, place, hash FROM o WHERE size > 1),
             b AS (SELECT a.tree, a.level, a.place, coalesce(string_agg(c.hash, '' ORDER BY c.place) FILTER (c.place < a.place), '') AS lefts,
                          coalesce(string_agg(c.hash, '' ORDER BY c.place) FILTER (c.place > a.place), '') AS rights
                   FROM e a JOIN e c ON a.tree = c.tree AND a.level = c.level AND a.place // 3 = c.place // 3 GROUP BY a.tree, a.level, a.place),
             f AS (SELECT l.doc_id, l.leaf, l.tree, t.subroot, t.height, l.tree AS pos, 0 AS level, l.place, l.tampered AS hash, '' AS proof FROM l JOIN t ON l.tree = t.tree
                   UNION ALL
                   SELECT f.doc_id, f.leaf, f.tree, f.subroot, f.height, CASE WHEN b.level IS NULL THEN 0 ELSE f.pos END,
                          CASE WHEN b.level IS NULL THEN 0 ELSE f.level + 1 END, CASE WHEN b.level IS NULL THEN f.tree - 1 ELSE f.place // 3 END,
                          CASE WHEN b.level IS NULL THEN f.hash ELSE sha256(b.lefts || f.hash || b.rights) END, f.proof || coalesce(b.lefts || b.rights, '')
                   FROM f LEFT JOIN b ON b.tree = f.pos AND b.level = f.level AND b.place = f.place WHERE b.level IS NOT NULL OR f.pos > 0),
             r AS (SELECT hash AS root FROM o WHERE size = 1)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, hash AS folded_root, hash = root AS verified
        FROM f, r WHERE pos = 0 AND level = (SELECT max(level) FROM o)
    """,
}
