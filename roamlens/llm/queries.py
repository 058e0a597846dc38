"""The registered queries ``opN_<name>``: each applies its operator to its whole
table with production parameters; ``ORACLES`` has DuckDB SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamlens.llm import arc_warc, collision_search, fill_in_middle, html_blocks, minhash, mixing, ordinal_quality, piece_trie, pseudonyms, repetition, simhash, source_divergence, token_codes
from roamlens.llm.common import load

def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file: in the folder LLM_TOKENIZERS if set, else
    where the package of vocabulary files has it."""
    folder = os.environ.get("LLM_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.token_codes(load(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(load(spark, sf_dir, "documents"))


def op3_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"))


def op4_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(load(spark, sf_dir, "pages"))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal_quality.train(docs, load(spark, sf_dir, "labels"))
    return ordinal_quality.quality(docs, model).drop("text")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_warc.archive_pages(load(spark, sf_dir, "pages"))


def op9_shared_prefix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to piece ids and back."""
    model = tokenizer_file("piece_bpe_32k.model")
    both = piece_trie.decode(piece_trie.encode(load(spark, sf_dir, "documents"), model), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxhash64"),
                       F.length("text").cast("long").alias("decoded_chars"), F.md5("text").alias("decoded_md5"))


def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonyms(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_wavelet_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle.restore(fill_in_middle.fill_in_middle(load(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


def op12_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op13_level_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(load(spark, sf_dir, "documents"))


SQL_ARCHIVE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""

SQL_MIX = rf"""
WITH sized AS (
  SELECT doc_id, source, md5(text) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws('|', '{mixing.SEED}', doc_id::VARCHAR)) AS key
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS place
  FROM sized GROUP BY source),
capped AS (
  SELECT *, 3 * source_size AS cap, ([5, 2, 1])[(place % 3 + 1)::INT]::BIGINT AS w FROM per),
sums AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, place
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
         sum(w) OVER (ORDER BY cap::DOUBLE / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares
  FROM capped),
level AS (
  SELECT words_left AS l, shares AS s FROM sums WHERE cap * shares >= w * words_left
  ORDER BY cap::DOUBLE / w, place LIMIT 1),
goal AS (
  SELECT source, source_size, least(cap::DOUBLE, (w * l)::DOUBLE / s::DOUBLE) AS target FROM sums, level),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, round(g.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size, d.h
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size
         + greatest(0, least(size, budget % source_size - place)) ELSE 0 END)::BIGINT AS taken
FROM placed
"""

SQL_FILL_IN_MIDDLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tok
  FROM documents),
d AS (
  SELECT *, len(tok)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
              THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, array_to_string(tok[1:a], '') AS prefix, array_to_string(tok[a + 1:b], '') AS middle,
         array_to_string(tok[b + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

SQL_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
e AS (SELECT i, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM e GROUP BY 1, 2 HAVING count(DISTINCT i) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (
  SELECT g.lang, g.source, k.term, count(e.i) AS n
  FROM grp g JOIN kept k ON k.lang = g.lang LEFT JOIN e ON e.lang = g.lang AND e.source = g.source AND e.term = k.term
  GROUP BY 1, 2, 3),
p AS (
  SELECT lang, source, term, n,
         1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p
  FROM c JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2),
q AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM l JOIN v USING (lang)),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY 1, 2, 4),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

QUERIES = {f.__name__: f for f in (
    op1_token_codes, op2_repetition_rules, op3_minmax_near_duplicates, op4_collision_search,
    op5_html_blocks, op6_ordinal_quality, op7_mix_sources, op8_arc_to_warc, op9_shared_prefix_pieces, op10_feistel_pseudonyms,
    op11_wavelet_fill_in_middle, op12_simhash_blocks, op13_level_products)}
ORACLES = {"op7_mix_sources": SQL_MIX, "op8_arc_to_warc": SQL_ARCHIVE, "op11_wavelet_fill_in_middle": SQL_FILL_IN_MIDDLE,
           "op13_level_products": SQL_DIVERGENCE}
