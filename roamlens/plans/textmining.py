"""Text-mining queries over documents (+ labels): tokens, stop words, class
frequencies, chi-square selection, bigrams, TF-IDF, word clouds, lexicon
sentiment, dictionary segmentation (SURVEY §2.10, §2.14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roamlens.operators import features as FT
from roamlens.operators import lexicon as LX
from roamlens.operators import text as TX
from roamlens.plans.registry import register
from roamlens.plans.standins import Tables
from roamlens.session import cut_lineage

# Stop-word list (frequent function words of the four corpus
# languages), used by the stop-word and word-cloud queries.
STOP_WORDS = ["the", "and", "of", "to", "a", "in", "is", "it", "that", "for", "with", "as", "on",
              "was", "by", "this", "are", "from", "le", "la", "les", "de", "des", "et", "un",
              "une", "du", "en", "qui", "que", "der", "die", "das", "und", "ist", "den", "von",
              "el", "los", "las", "y", "es"]

# Sentiment lexicon of frequent corpus tokens: (word, kind, weight, ord).
# kind: sen = sentiment score, not = negation, deg = degree adverb.  'to' is in
# all three lists (degree wins); 'is' appears twice (the later score wins).
LEXICON = [
    ("the", "sen", 1.0, 1), ("de", "sen", -0.5, 2), ("la", "sen", 2.0, 3), ("is", "sen", 0.5, 4),
    ("en", "sen", -1.0, 5), ("it", "sen", 1.5, 6), ("was", "sen", -2.0, 7), ("que", "sen", 0.75, 8),
    ("le", "sen", -0.25, 9), ("be", "sen", 1.25, 10), ("et", "sen", -1.5, 11), ("are", "sen", 0.5, 12),
    ("is", "sen", 0.7, 13), ("to", "sen", 3.0, 14),
    ("des", "not", 0.0, 15), ("von", "not", 0.0, 16), ("to", "not", 0.0, 17), ("un", "not", 0.0, 18),
    ("of", "deg", 1.5, 19), ("and", "deg", 2.0, 20), ("a", "deg", 0.5, 21), ("der", "deg", 3.0, 22),
    ("that", "deg", 1.2, 23), ("in", "deg", 0.8, 24), ("to", "deg", 1.1, 25),
]

# Segmentation dictionary (overlapping English fragments).
DICTIONARY = ["the", "then", "he", "her", "here", "there", "and", "an", "on", "one", "tion", "ion",
              "ing", "in", "er", "ere", "th", "sh", "ou"]

K_BEST = 1500
BIGRAMS_PER_CORPUS = 5000
BIGRAMS_PER_DOC = 1000
BIGRAMS_PER_CLASS = 5000
FEATURE_BIGRAMS = 20
KEYWORDS = 100

# ------------------------------------------------------------------ SQL fragments
TOK = r"regexp_extract_all(lower(text), '\p{L}+')"
TOK_ALNUM = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
LABELLED_SQL = f"""SELECT d.doc_id, l.quality AS label, {TOK.replace('text', 'd.text')} AS w
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def chi_sql(a, ix, xi, n):
    a, ix, xi, n = (f"CAST({x} AS DOUBLE)" for x in (a, ix, xi, n))
    b = f"({ix} - {a})"
    c = f"({xi} - {a})"
    d = f"({n} - {a} - {b} - {c})"
    den = f"(({a} + {b}) * ({a} + {c}) * ({b} + {d}) * ({c} + {d}))"
    return f"(CASE WHEN {den} = 0 THEN 0.0 ELSE {n} * pow({a} * {d} - {b} * {c}, 2) / {den} END)"


def pmi_sql(a, ix, xi, n):
    num = f"(CAST({a} AS DOUBLE) * CAST({n} AS DOUBLE))"
    den = f"(CAST({ix} AS DOUBLE) * CAST({xi} AS DOUBLE))"
    return f"(CASE WHEN {num} <= 0 OR {den} <= 0 THEN NULL ELSE log2({num} / {den}) END)"


def _docs(t):
    return TX.tokenize(t["documents"].select("doc_id", "text", "lang"), "text")


def _labelled(t):
    d = _docs(t)
    l = t["labels"].select("doc_id", F.col("quality").alias("label"))
    return d.join(l, "doc_id")


def _lexicon(spark):
    return spark.createDataFrame(LEXICON, "word string, kind string, weight double, ord int")


# ------------------------------------------------------------------ tokens / stop words
@register("tokens_count", ids="N1 N18", sql=f"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct
FROM (SELECT doc_id, {TOK} AS w FROM documents)""")
def tokens_count(spark, sf_dir):
    d = _docs(Tables(spark, sf_dir))
    return d.select("doc_id", F.size("words").cast("long").alias("n_tokens"),
                    F.size(FT.bag_of_words("words")).cast("long").alias("n_distinct"))


@register("stopword_filter", ids="N3 P8", sql=f"""
SELECT doc_id, CAST(len(k) AS BIGINT) AS n_kept, array_to_string(k, ' ') AS kept
FROM (SELECT doc_id, list_filter({TOK}, lambda x: NOT list_contains({STOP_SQL}, x)) AS k FROM documents)""")
def stopword_filter(spark, sf_dir):
    d = TX.remove_stop_words(_docs(Tables(spark, sf_dir)), "words", STOP_WORDS, out="kept_w")
    return d.select("doc_id", F.size("kept_w").cast("long").alias("n_kept"),
                    F.array_join("kept_w", " ").alias("kept"))


@register("numeric_stop_filter", ids="P7 P8 U4", sql=f"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(k) AS BIGINT) AS n_kept
FROM (SELECT doc_id, {TOK_ALNUM} AS w,
        list_filter({TOK_ALNUM}, lambda x: NOT list_contains({STOP_SQL}, x) AND NOT
          (regexp_matches(x, '^[0-9]{{1,4}}$') AND (x = '0' OR left(x, 1) <> '0'))) AS k
      FROM documents)""")
def numeric_stop_filter(spark, sf_dir):
    d = TX.tokenize(Tables(spark, sf_dir)["documents"], "text", mode="alnum")
    d = TX.remove_stop_words(d, "words", STOP_WORDS, out="kept_w", numeric=True)
    return d.select("doc_id", F.size("words").cast("long").alias("n_tokens"),
                    F.size("kept_w").cast("long").alias("n_kept"))


@register("word_freq_by_class", ids="A13 A14", sql=f"""
WITH t AS (SELECT label, unnest(w) AS word FROM ({LABELLED_SQL}))
SELECT word, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_pos,
       count(*) FILTER (WHERE label <> 1) AS n_neg FROM t GROUP BY word""")
def word_freq_by_class(spark, sf_dir):
    return TX.word_counts(_labelled(Tables(spark, sf_dir)), "words", "label")


SQL_WORD_SCORES = f"""
WITH t AS (SELECT label, unnest(w) AS word FROM ({LABELLED_SQL})),
c AS (SELECT word, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_pos FROM t GROUP BY word),
tot AS (SELECT count(*) AS big_n, count(*) FILTER (WHERE label = 1) AS big_p FROM t),
s AS (SELECT word, n, n_pos, n - n_pos AS n_neg,
        round({chi_sql('n_pos', 'n', 'big_p', 'big_n')} + {chi_sql('n - n_pos', 'n', 'big_n - big_p', 'big_n')}, 6) AS score
      FROM c, tot)"""


@register("word_scores", ids="N7 A15 F1", sql=SQL_WORD_SCORES + "\nSELECT * FROM s")
def word_scores(spark, sf_dir):
    return FT.class_scores(_labelled(Tables(spark, sf_dir)), "words", "label")


@register("best_words", ids="T2", sql=SQL_WORD_SCORES +
          f"\nSELECT word, score FROM s ORDER BY score DESC, word LIMIT {K_BEST}")
def best_words(spark, sf_dir):
    s = FT.class_scores(_labelled(Tables(spark, sf_dir)), "words", "label")
    return FT.best_words(s, K_BEST).select("word", "score")


@register("best_word_features", ids="N9 J11", sql=SQL_WORD_SCORES + f""",
b AS (SELECT word FROM s ORDER BY score DESC, word LIMIT {K_BEST}),
bl AS (SELECT list(word) AS bw FROM b),
f AS (SELECT doc_id, label, list_sort(list_distinct(list_filter(w, lambda x: list_contains(bl.bw, x)))) AS fw
      FROM ({LABELLED_SQL}), bl)
SELECT doc_id, label, CAST(len(fw) AS BIGINT) AS n_features, array_to_string(fw, ' ') AS features FROM f""")
def best_word_features(spark, sf_dir):
    t = Tables(spark, sf_dir)
    lab = _labelled(t)
    best = FT.best_words(FT.class_scores(lab, "words", "label"), K_BEST)
    f = FT.best_word_features(lab, "doc_id", "words", best)
    return f.select("doc_id", "label", F.size("features").cast("long").alias("n_features"),
                    F.array_join("features", " ").alias("features"))


# ------------------------------------------------------------------ bigrams
SQL_PAIRS = f"""
WITH t AS (SELECT doc_id, {TOK} AS w FROM documents),
p AS (SELECT doc_id, w[i] AS w1, w[i + 1] AS w2
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 2))"""


@register("bigram_counts", ids="W2", sql=SQL_PAIRS + "\nSELECT w1, w2, count(*) AS n FROM p GROUP BY 1, 2")
def bigram_counts(spark, sf_dir):
    d = _docs(Tables(spark, sf_dir))
    return (d.select(F.explode(FT.bigrams("words")).alias("b"))
            .groupBy(F.col("b.w1").alias("w1"), F.col("b.w2").alias("w2")).agg(F.count(F.lit(1)).alias("n")))


SQL_BIGRAM_SCORES = SQL_PAIRS + f""",
u AS (SELECT word, count(*) AS c FROM (SELECT unnest(w) AS word FROM t) GROUP BY 1),
tot AS (SELECT sum(c) AS n_xx FROM u),
pc AS (SELECT w1, w2, count(*) AS n_ii FROM p GROUP BY 1, 2),
s AS (SELECT pc.w1, pc.w2, n_ii, u1.c AS n_ix, u2.c AS n_xi, CAST(n_xx AS BIGINT) AS n_xx,
        round({chi_sql('n_ii', 'u1.c', 'u2.c', 'n_xx')}, 6) AS chi_sq,
        round({pmi_sql('n_ii', 'u1.c', 'u2.c', 'n_xx')}, 6) AS pmi
      FROM pc JOIN u u1 ON u1.word = pc.w1 JOIN u u2 ON u2.word = pc.w2, tot)"""


@register("bigram_scores", ids="N5 F1 T3", sql=SQL_BIGRAM_SCORES +
          f"\nSELECT * FROM s ORDER BY chi_sq DESC, w1, w2 LIMIT {BIGRAMS_PER_CORPUS}")
def bigram_scores(spark, sf_dir):
    s = FT.bigram_scores(_docs(Tables(spark, sf_dir)), "words")
    return FT.top_bigrams(s.withColumn("n_xx", F.col("n_xx").cast("long")), BIGRAMS_PER_CORPUS)


@register("doc_bigram_top", ids="N5 T3", sql=SQL_PAIRS + f""",
u AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(w) AS word FROM t) GROUP BY 1, 2),
tot AS (SELECT doc_id, sum(c) AS n_xx FROM u GROUP BY 1),
pc AS (SELECT doc_id, w1, w2, count(*) AS n_ii FROM p GROUP BY 1, 2, 3),
s AS (SELECT pc.doc_id, pc.w1, pc.w2, n_ii, round({chi_sql('n_ii', 'u1.c', 'u2.c', 'tot.n_xx')}, 6) AS chi_sq
      FROM pc JOIN u u1 ON u1.doc_id = pc.doc_id AND u1.word = pc.w1
      JOIN u u2 ON u2.doc_id = pc.doc_id AND u2.word = pc.w2 JOIN tot ON tot.doc_id = pc.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chi_sq DESC, w1, w2) AS rank FROM s)
SELECT doc_id, w1, w2, n_ii, chi_sq, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {BIGRAMS_PER_DOC}""")
def doc_bigram_top(spark, sf_dir):
    return FT.top_document_bigrams(_docs(Tables(spark, sf_dir)), "words", "doc_id", BIGRAMS_PER_DOC)


@register("word_bigram_scores", ids="N7 U2", sql=f"""
WITH lt AS ({LABELLED_SQL}),
t AS (SELECT label, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1),
        lambda i: w[i] || '_' || w[i + 1]))) AS word FROM lt),
c AS (SELECT word, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_pos FROM t GROUP BY word),
tot AS (SELECT count(*) AS big_n, count(*) FILTER (WHERE label = 1) AS big_p FROM t),
s AS (SELECT word, n, n_pos, n - n_pos AS n_neg,
        round({chi_sql('n_pos', 'n', 'big_p', 'big_n')} + {chi_sql('n - n_pos', 'n', 'big_n - big_p', 'big_n')}, 6) AS score
      FROM c, tot)
SELECT * FROM s ORDER BY score DESC, word LIMIT {K_BEST}""")
def word_bigram_scores(spark, sf_dir):
    lab = _labelled(Tables(spark, sf_dir)).withColumn("feats", FT.word_and_bigram_features("words"))
    return FT.best_words(FT.class_scores(lab, "feats", "label"), K_BEST)


def _collocation_sql(by: str) -> str:
    """CTEs: both measures of the bigrams inside each ``by`` group."""
    return f"""
p AS (SELECT {by}, w[i] AS w1, w[i + 1] AS w2
      FROM (SELECT {by}, w, unnest(generate_series(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 2)),
u AS (SELECT {by}, word, count(*) AS c FROM (SELECT {by}, unnest(w) AS word FROM t) GROUP BY 1, 2),
tot AS (SELECT {by}, sum(c) AS n_xx FROM u GROUP BY 1),
pc AS (SELECT {by}, w1, w2, count(*) AS n_ii FROM p GROUP BY 1, 2, 3),
s AS (SELECT pc.{by}, pc.w1, pc.w2, n_ii, round({chi_sql('n_ii', 'u1.c', 'u2.c', 'tot.n_xx')}, 6) AS chi_sq,
             round({pmi_sql('n_ii', 'u1.c', 'u2.c', 'tot.n_xx')}, 6) AS pmi
      FROM pc JOIN u u1 ON u1.{by} = pc.{by} AND u1.word = pc.w1
      JOIN u u2 ON u2.{by} = pc.{by} AND u2.word = pc.w2 JOIN tot ON tot.{by} = pc.{by}),
m AS (SELECT {by}, w1, w2, n_ii, 'chi_sq' AS measure, chi_sq AS score FROM s UNION ALL SELECT {by}, w1, w2, n_ii, 'pmi', pmi FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY {by}, measure ORDER BY score DESC, w1, w2) AS rank FROM m)"""


@register("doc_collocation_features", ids="N6 F1 U2", sql=f"""
WITH t AS (SELECT doc_id, {TOK} AS w FROM documents),{_collocation_sql('doc_id')},
b AS (SELECT doc_id, measure, string_agg(w1 || '_' || w2, ' ' ORDER BY rank) AS best FROM r WHERE rank <= {FEATURE_BIGRAMS} GROUP BY 1, 2)
SELECT t.doc_id, x.measure, concat_ws(' ', nullif(array_to_string(t.w, ' '), ''), b.best) AS features
FROM t CROSS JOIN (SELECT unnest(['chi_sq', 'pmi']) AS measure) x LEFT JOIN b ON b.doc_id = t.doc_id AND b.measure = x.measure""")
def doc_collocation_features(spark, sf_dir):
    """Words and the best bigrams of each document under either measure."""
    d = _docs(Tables(spark, sf_dir)).select("doc_id", "words")
    both = [FT.best_bigram_features(d, "doc_id", "words", FEATURE_BIGRAMS, score=m).select(
        "doc_id", F.lit(m).alias("measure"), F.array_join("features", " ").alias("features")) for m in ("chi_sq", "pmi")]
    return both[0].unionByName(both[1])


@register("class_collocations", ids="N8 F1 T3", sql=f"""
WITH t AS ({LABELLED_SQL}),{_collocation_sql('label')}
SELECT label, measure, w1, w2, n_ii, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {BIGRAMS_PER_CLASS}""")
def class_collocations(spark, sf_dir):
    """The best bigrams of either class under either measure."""
    lab = _labelled(Tables(spark, sf_dir))
    both = [FT.class_collocations(lab, "label", "words", BIGRAMS_PER_CLASS, m).select(
        "label", F.lit(m).alias("measure"), "w1", "w2", "n_ii", F.col(m).alias("score"), "rank") for m in ("chi_sq", "pmi")]
    return both[0].unionByName(both[1])


@register("collocation_word_scores", ids="N8 N7 F1", sql=f"""
WITH t AS ({LABELLED_SQL}),{_collocation_sql('label')},
f AS (SELECT label, unnest(w) AS word FROM t
      UNION ALL SELECT label, w1 || '_' || w2 FROM r WHERE measure = 'chi_sq' AND rank <= {BIGRAMS_PER_CLASS}),
c AS (SELECT word, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_pos FROM f GROUP BY word),
n AS (SELECT count(*) AS big_n, count(*) FILTER (WHERE label = 1) AS big_p FROM f)
SELECT word, n, n_pos, n - n_pos AS n_neg,
       round({chi_sql('n_pos', 'n', 'big_p', 'big_n')} + {chi_sql('n - n_pos', 'n', 'big_n - big_p', 'big_n')}, 6) AS score FROM c, n""")
def collocation_word_scores(spark, sf_dir):
    return FT.collocation_word_scores(_labelled(Tables(spark, sf_dir)), "label", "words", BIGRAMS_PER_CLASS)


@register("bag_of_words", ids="N4 U3", sql=f"""
SELECT doc_id, array_to_string(list_sort(list_distinct({TOK})), ' ') AS bag FROM documents""")
def bag_of_words(spark, sf_dir):
    d = _docs(Tables(spark, sf_dir))
    return d.select("doc_id", F.array_join(F.array_sort(FT.bag_of_words("words")), " ").alias("bag"))


@register("bigram_word_features", ids="N6 U2", sql=f"""
SELECT doc_id, CAST(len(list_distinct(list_concat(w, list_transform(generate_series(1, len(w) - 1),
        lambda i: w[i] || '_' || w[i + 1])))) AS BIGINT) AS n_features
FROM (SELECT doc_id, {TOK} AS w FROM documents)""")
def bigram_word_features(spark, sf_dir):
    d = _docs(Tables(spark, sf_dir))
    return d.select("doc_id", F.size(F.array_distinct(FT.word_and_bigram_features("words")))
                    .cast("long").alias("n_features"))


SEGMENT_WORDS = 300


@register("dictionary_tokens", ids="N1", sql=f"""
WITH RECURSIVE t AS (SELECT doc_id, {TOK} AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS r, unnest(range(1, len(w) + 1)) AS p FROM t),
d AS (SELECT r AS word, count(*) AS freq FROM e WHERE length(r) BETWEEN 2 AND 5 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {SEGMENT_WORDS}),
k AS (SELECT ln(sum(freq)) AS total FROM d),
runs AS (SELECT DISTINCT r FROM e),
starts AS (SELECT r, unnest(range(1, length(r) + 1)) AS i FROM runs),
hits AS (SELECT r, i, len, ln(freq) - total AS s FROM (SELECT r, i, unnest(range(1, least(5, length(r) - i + 1) + 1)) AS len FROM starts)
           JOIN d ON d.word = substr(r, i, len), k
         UNION ALL SELECT r, i, 1, -total FROM starts, k),
h AS (SELECT r, i, list({{'s': s, 'l': len}}) AS c FROM hits GROUP BY 1, 2),
dp(r, i, best, take) AS (
  SELECT r, length(r), [CAST(0 AS DOUBLE)], CAST([] AS BIGINT[]) FROM runs
  UNION ALL
  SELECT r, i - 1, list_prepend(c.s, best), list_prepend(c.l, take)
  FROM (SELECT dp.r, dp.i, best, take, list_reverse_sort(list_transform(h.c, lambda x: {{'s': x.s + best[x.l], 'l': x.l}}))[1] AS c
        FROM dp JOIN h ON h.r = dp.r AND h.i = dp.i)),
walk(r, i, take) AS (
  SELECT r, CAST(1 AS BIGINT), take FROM dp WHERE i = 0
  UNION ALL SELECT r, i + take[i], take FROM walk WHERE i + take[i] <= length(r)),
pieces AS (SELECT r, count(*) AS n, string_agg(substr(r, i, take[i]), ' ' ORDER BY i) AS words FROM walk GROUP BY 1)
SELECT t.doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_tokens, coalesce(string_agg(words, ' ' ORDER BY p), '') AS tokens
FROM t LEFT JOIN e ON e.doc_id = t.doc_id LEFT JOIN pieces ON pieces.r = e.r GROUP BY 1""")
def dictionary_tokens(spark, sf_dir):
    """Every run of letters of the documents cut by their own most frequent short words."""
    docs = Tables(spark, sf_dir)["documents"].select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = TX.tokenize(docs, "text").select(F.explode("words").alias("word")).filter(F.length("word").between(2, 5))
    known = words.groupBy("word").agg(F.count(F.lit(1)).alias("freq")).orderBy(F.desc("freq"), "word").limit(SEGMENT_WORDS)
    cut = TX.tokenize(docs, "text", out="tokens", mode="dictionary", key="doc_id", dictionary=known)
    return cut.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


# ------------------------------------------------------------------ keywords / clouds
@register("tfidf_keywords", ids="N10 T4", sql=f"""
WITH t AS (SELECT doc_id, lang, unnest({TOK}) AS word FROM documents),
nd AS (SELECT count(DISTINCT doc_id) AS big_n FROM documents),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM t GROUP BY 1),
tf AS (SELECT lang, word, count(*) AS n FROM t GROUP BY 1, 2),
tot AS (SELECT lang, sum(n) AS total FROM tf GROUP BY 1),
s AS (SELECT tf.lang, tf.word, tf.n, df.df, round(tf.n / tot.total * ln((big_n + 1) / (df.df + 1)), 6) AS weight
      FROM tf JOIN tot ON tf.lang = tot.lang JOIN df ON df.word = tf.word, nd),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, word) AS rank FROM s)
SELECT lang, word, n, df, weight, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {KEYWORDS}""")
def tfidf_keywords(spark, sf_dir):
    return TX.tfidf_keywords(_docs(Tables(spark, sf_dir)), "lang", "doc_id", "words", KEYWORDS)


@register("cloud_weights", ids="N11 N3", sql=f"""
WITH t AS (SELECT lang, unnest(list_filter({TOK}, lambda x: NOT list_contains({STOP_SQL}, x))) AS word FROM documents),
c AS (SELECT lang, word, count(*) AS n FROM t GROUP BY 1, 2),
r AS (SELECT *, round(n / max(n) OVER (PARTITION BY lang), 6) AS weight,
             row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c)
SELECT lang, word, n, weight, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {KEYWORDS}""")
def cloud_weights(spark, sf_dir):
    d = TX.remove_stop_words(_docs(Tables(spark, sf_dir)), "words", STOP_WORDS)
    return TX.cloud_weights(d, "lang", "words", KEYWORDS).select("lang", "word", "n", "weight", "rank")


DICT_SQL = "(VALUES " + ", ".join(f"('{w}')" for w in DICTIONARY) + ") AS dct(word)"


@register("dictionary_segments", ids="N2", sql=fr"""
WITH t AS (SELECT doc_id, lower(text) AS s FROM documents),
pos AS (SELECT doc_id, s, CAST(unnest(generate_series(1, greatest(length(s), 1))) AS INTEGER) AS start FROM t),
lens AS (SELECT CAST(unnest(generate_series(1, {max(len(w) for w in DICTIONARY)})) AS INTEGER) AS len),
sub AS (SELECT doc_id, start, len, substr(s, start, len) AS word FROM pos, lens WHERE start + len - 1 <= length(s)),
hits AS (SELECT sub.doc_id, sub.start, sub.len, sub.word FROM sub JOIN {DICT_SQL} ON dct.word = sub.word),
cover AS (SELECT DISTINCT doc_id, CAST(unnest(generate_series(start, start + len - 1)) AS INTEGER) AS start FROM hits),
single AS (SELECT p.doc_id, p.start, 1 AS len, substr(p.s, p.start, 1) AS word FROM pos p
           WHERE regexp_matches(substr(p.s, p.start, 1), '^\p{{L}}$')
             AND NOT EXISTS (SELECT 1 FROM cover c WHERE c.doc_id = p.doc_id AND c.start = p.start))
SELECT * FROM hits UNION ALL SELECT * FROM single""")
def dictionary_segments(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = spark.createDataFrame([(w,) for w in DICTIONARY], "word string")
    return TX.dictionary_segments(t["documents"], "doc_id", "text", d).select("doc_id", "start", "len", "word")


# ------------------------------------------------------------------ lexicon sentiment
LEX_VALUES = "(VALUES " + ", ".join(f"('{w}', '{k}', {x}, {o})" for w, k, x, o in LEXICON) + ") AS raw(word, kind, weight, ord)"
SQL_HITS = f"""
WITH t AS (SELECT doc_id, {TOK} AS w FROM documents),
ex AS (SELECT doc_id, unnest(w) AS word, CAST(unnest(range(0, len(w))) AS INTEGER) AS pos FROM t),
pr AS (SELECT *, CASE kind WHEN 'deg' THEN 0 WHEN 'not' THEN 1 ELSE 2 END AS p FROM {LEX_VALUES}),
lex AS (SELECT word, kind, CASE WHEN kind = 'not' THEN -1.0 ELSE CAST(weight AS DOUBLE) END AS weight
        FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY p, ord DESC) AS rn FROM pr) WHERE rn = 1),
hits AS (SELECT doc_id, word, max(pos) AS pos, any_value(kind) AS kind, any_value(weight) AS weight
         FROM ex JOIN lex USING (word) GROUP BY doc_id, word)"""
SQL_SCORES = SQL_HITS + """,
fs AS (SELECT doc_id, min(pos) AS first_sen FROM hits WHERE kind = 'sen' GROUP BY doc_id),
f AS (SELECT h.*, CASE WHEN h.kind <> 'sen' AND h.pos > fs.first_sen THEN h.weight ELSE 1.0 END AS factor
      FROM hits h LEFT JOIN fs ON fs.doc_id = h.doc_id),
wv AS (SELECT *, coalesce(product(factor) OVER (PARTITION BY doc_id ORDER BY pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS big_w FROM f),
sc AS (SELECT doc_id, sum(CASE WHEN kind = 'sen' THEN big_w * weight ELSE 0.0 END) AS score FROM wv GROUP BY doc_id),
scores AS (SELECT d.doc_id, round(coalesce(sc.score, 0.0), 6) AS score FROM documents d LEFT JOIN sc ON sc.doc_id = d.doc_id)"""


def _scores(spark, sf_dir):
    d = _docs(Tables(spark, sf_dir))
    return LX.lexicon_score(d, "doc_id", "words", _lexicon(spark))


@register("lexicon_hits", ids="J5 N12 W3", sql=SQL_HITS + "\nSELECT doc_id, word, pos, kind, weight FROM hits")
def lexicon_hits(spark, sf_dir):
    d = _docs(Tables(spark, sf_dir))
    return LX.lexicon_hits(d, "doc_id", "words", _lexicon(spark)).select("doc_id", "word", "pos", "kind", "weight")


@register("lexicon_classify", ids="J5 N12 A16", sql=SQL_HITS + """
SELECT word, any_value(kind) AS kind, any_value(weight) AS weight, count(*) AS n_docs FROM hits GROUP BY word""")
def lexicon_classify(spark, sf_dir):
    d = _docs(Tables(spark, sf_dir))
    h = LX.lexicon_hits(d, "doc_id", "words", _lexicon(spark))
    return h.groupBy("word").agg(F.first("kind").alias("kind"), F.first("weight").alias("weight"),
                                 F.count(F.lit(1)).alias("n_docs"))


@register("lexicon_score", ids="N13 W4", sql=SQL_SCORES + "\nSELECT * FROM scores")
def lexicon_score(spark, sf_dir):
    return _scores(spark, sf_dir)


@register("lexicon_score_window", ids="W4 N13", sql=SQL_SCORES + "\nSELECT * FROM scores")
def lexicon_score_window(spark, sf_dir):
    d = _docs(Tables(spark, sf_dir))
    return LX.lexicon_score_window(d, "doc_id", "words", _lexicon(spark))


@register("score_rank", ids="W1 T1", sql=SQL_SCORES + """
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores""")
def score_rank(spark, sf_dir):
    scores = cut_lineage(_scores(spark, sf_dir))  # two columns, read by each pass of the ranking
    return LX.score_rank(scores, "doc_id").select("doc_id", "score", "rank")


@register("score_summary", ids="A23", sql=SQL_SCORES + """
SELECT count(score) AS n_docs, round(avg(score), 6) AS mean, min(score) AS min, max(score) AS max,
       count(*) FILTER (WHERE score > 0) AS n_positive, count(*) FILTER (WHERE score < 0) AS n_negative FROM scores""")
def score_summary(spark, sf_dir):
    return LX.score_summary(_scores(spark, sf_dir))


@register("conversation_join", ids="P11", sql="""
SELECT conv_id, count(*) AS n_turns, string_agg(text, '。' ORDER BY turn) AS joined
FROM conversations GROUP BY conv_id""")
def conversation_join(spark, sf_dir):
    """P11 per group: a conversation's turns joined in order (a conversation
    is a bounded group, so its texts are collected)."""
    from roamlens.operators.relational import join_texts
    c = Tables(spark, sf_dir)["conversations"]
    n = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    return join_texts(c, "conv_id", "turn", "text", sep="。").join(n, "conv_id").select("conv_id", "n_turns", "joined")


@register("char_tokens_count", ids="N1", sql=r"""
SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '\p{L}')) AS BIGINT) AS n_chars,
       CAST(len(list_distinct(regexp_extract_all(lower(text), '\p{L}'))) AS BIGINT) AS n_distinct
FROM documents""")
def char_tokens_count(spark, sf_dir):
    """N1 'chars' mode (unspaced scripts: every letter is a token)."""
    b = TX.tokenize(Tables(spark, sf_dir)["documents"], "text", mode="chars")
    return b.select("doc_id", F.size("words").cast("long").alias("n_chars"),
                    F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))
