"""The thin opN queries: each reads its whole table, runs its operator and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import load

from . import (
    decontamination,
    edit_embedding,
    embedding_dedup,
    language_id,
    lexical_search,
    line_dedup,
    minhash_dedup,
    packing,
    prefix_trie,
    quote_links,
    sentence_spans,
    suffix_dedup,
    toxicity,
)


def digest(column: str = "text"):
    return F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quote_links.reply_order(load(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "text", "n_quotes", "n_linked", "parent_turn", "branch_depth", "reply_order")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", digest().alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentence_spans.drop_repeated_spans(load(spark, sf_dir, "documents"), lengthen=True)
    return out.select("doc_id", "n_sentences", "n_removed", "n_spans", digest().alias("kept_sha256"))


def op5_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.neighbours(load(spark, sf_dir, "documents"))


def edit_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of operator 5: banding of the sampled bits and verification."""
    return edit_embedding.near_documents(load(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(load(spark, sf_dir, "documents"), k=4, percent=80)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(load(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_hits(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(load(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(load(spark, sf_dir, "conversations"), rebuild=True)


QUERIES = {
    "op1_quote_links": op1_quote_links,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_sentence_spans": op4_sentence_spans,
    "op5_edit_embedding": op5_edit_embedding,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_language_id": op7_language_id,
    "op8_decontamination": op8_decontamination,
    "op10_toxicity": op10_toxicity,
    "op9_packing": op9_packing,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_prefix_trie": op13_prefix_trie,
    "edit_near_documents": edit_near_documents,
}

ORACLE: dict[str, str] = {}

ORACLE["op3_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, p.i AS pos, p.line AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(d.ls) AS line, unnest(range(len(d.ls))) AS i) p
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), rep AS (
  SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.doc_id, pos, line, rep.k IS NOT NULL AND keyed.doc_id <> rep.owner AS gone
  FROM keyed LEFT JOIN rep ON keyed.k = rep.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE["op11_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counted USING (vec_id)
"""

_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""
ORACLE["op12_lexical_search"] = f"""
WITH t AS (SELECT doc_id, {_TERMS} FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
g AS (SELECT count(*) AS cn, sum(n)::BIGINT AS cl FROM d),
q AS (SELECT DISTINCT item_id, {_TERMS} FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT cn FROM g) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p GROUP BY term),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * cn) // cl)))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id), g GROUP BY item_id, doc_id
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

#: crc32 of the decimal id is computed byte by byte with the usual polynomial.
ORACLE["op13_prefix_trie"] = """
WITH RECURSIVE poly(k, i, v) AS (
  SELECT k, 0, k FROM range(256) r(k)
  UNION ALL SELECT k, i + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM poly WHERE i < 8
), tab AS (SELECT list(v ORDER BY k) AS t FROM poly WHERE i = 8),
own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         coalesce(role, '') AS role, coalesce(text, '') AS body
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 5 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                         lambda acc, b: xor(acc // 256, t[1 + xor(acc % 256, b)])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM own), tab
), rebuilt AS (
  SELECT convs.c, i, role, body FROM convs JOIN own ON own.c = base AND i <= h
  UNION ALL SELECT own.c, 1000000 + i, role, body FROM convs JOIN own ON own.c = convs.c AND i > h
), turns AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS pos, sha256(len(role) || ':' || role || body) AS t, strlen(body) AS bytes FROM rebuilt
), prefixes AS (
  SELECT c, pos, bytes, sha256(string_agg(t, '' ORDER BY pos) OVER (PARTITION BY c ORDER BY pos)) AS node FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM convs
), parents AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY pos) AS above, lead(node) OVER (PARTITION BY c ORDER BY pos) IS NULL AS ends FROM prefixes),
nodes AS (
  SELECT node, min(c) AS conv_id, any_value(pos) AS depth, any_value(above) AS above, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM parents GROUP BY node
), kids AS (SELECT above AS node, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
below AS (
  SELECT p.node, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * n.bytes)::BIGINT AS saved_tokens
  FROM nodes n LEFT JOIN kids USING (node) JOIN prefixes p ON p.c = n.conv_id AND p.pos <= n.depth GROUP BY p.node
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN below USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes up ON up.node = n.above
"""
