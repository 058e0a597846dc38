"""Upsert, sampling, vectors, evaluation and ML queries (SURVEY S16, W5–W8,
T7, T8, U1, M*, A17–A21, S20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roamlens.functions.columns import round6
from roamlens.operators import evaluation as EV
from roamlens.operators import features as FT
from roamlens.operators import ml as ML
from roamlens.operators import sampling as SM
from roamlens.operators import upsert as UP
from roamlens.operators import vectors as VC
from roamlens.operators.relational import union_all
from roamlens.plans.registry import register
from roamlens.plans.standins import Tables
from roamlens.plans.textmining import (K_BEST, LABELLED_SQL, SQL_WORD_SCORES, TOK, _docs, _labelled)

TEST_N, DEV_N = 124, 50
FIRST_N = 100
TRAIN_FRACTION = 0.6


# ------------------------------------------------------------------ upsert
@register("latest_per_user", ids="S16 W5", sql="""
SELECT user_id, event_id, ts, event_type, value, props FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""")
def latest_per_user(spark, sf_dir):
    e = Tables(spark, sf_dir)["events"]
    return UP.latest_by_key(e, "user_id", ["ts", "event_id"]).select(
        "user_id", "event_id", "ts", "event_type", "value", "props")


@register("upsert_merge", ids="S16 Q2", sql="""
WITH u AS (SELECT event_id, user_id, event_type, value, 0 AS ingest_seq FROM events
           UNION ALL
           SELECT event_id, user_id, 'click_v2' AS event_type, round(value * 2 + 1, 6), 1 FROM events
           WHERE event_type = 'click')
SELECT event_id, user_id, event_type, value, ingest_seq FROM
  (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingest_seq DESC) AS rn FROM u) WHERE rn = 1""")
def upsert_merge(spark, sf_dir):
    e = Tables(spark, sf_dir)["events"]
    old = e.select("event_id", "user_id", "event_type", "value", F.lit(0).alias("ingest_seq"))
    new = e.filter(F.col("event_type") == "click").select(
        "event_id", "user_id", F.lit("click_v2").alias("event_type"),
        round6(F.col("value") * 2 + 1).alias("value"), F.lit(1).alias("ingest_seq"))
    return UP.upsert(old, new, ["event_id"], "ingest_seq")


# ------------------------------------------------------------------ labelled sets
def _labels(t):
    return t["labels"].select("doc_id", F.col("quality").alias("label"))


@register("union_labelled", ids="U1 M3", sql="""
SELECT d.doc_id, CAST(1.0 AS DOUBLE) AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1
UNION ALL
SELECT d.doc_id, CAST(0.0 AS DOUBLE) AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0""")
def union_labelled(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t["documents"].select("doc_id").join(t["labels"], "doc_id")
    pos = j.filter(F.col("quality") == 1).select("doc_id", F.lit(1.0).alias("label"))
    neg = j.filter(F.col("quality") == 0).select("doc_id", F.lit(0.0).alias("label"))
    return union_all([pos, neg])


MD5_ORDER = "md5(CAST(doc_id AS VARCHAR) || ':{seed}'), doc_id"


@register("first_n_per_class", ids="W7", sql=f"""
SELECT doc_id, label, rn FROM (SELECT doc_id, quality AS label,
  row_number() OVER (PARTITION BY quality ORDER BY {MD5_ORDER.format(seed=0)}) AS rn FROM labels)
WHERE rn <= {FIRST_N}""")
def first_n_per_class(spark, sf_dir):
    return SM.first_n_per_class(_labels(Tables(spark, sf_dir)), "label", "doc_id", FIRST_N, seed=0)


@register("seeded_split", ids="M6 T7", sql=f"""
SELECT doc_id, quality AS label,
  CASE WHEN CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':1'), 1, 8)) AS BIGINT) % 10000
       < {int(TRAIN_FRACTION * 10000)} THEN 'train' ELSE 'test' END AS split FROM labels""")
def seeded_split(spark, sf_dir):
    return SM.hash_split(_labels(Tables(spark, sf_dir)), "doc_id", 1, TRAIN_FRACTION)


@register("balanced_split", ids="T7 T8 W6", sql=f"""
WITH r AS (SELECT doc_id, quality AS label,
             row_number() OVER (PARTITION BY quality ORDER BY {MD5_ORDER.format(seed=0)}) AS rn FROM labels),
m AS (SELECT min(c) AS size FROM (SELECT count(*) AS c FROM labels GROUP BY quality))
SELECT doc_id, label, rn, CASE WHEN rn <= {TEST_N} THEN 'test' WHEN rn <= {TEST_N + DEV_N} THEN 'dev'
       ELSE 'train' END AS split
FROM r, m WHERE rn <= m.size""")
def balanced_split(spark, sf_dir):
    b = SM.balance_classes(_labels(Tables(spark, sf_dir)), "label", "doc_id", seed=0)
    return SM.slice_splits(b, [TEST_N, TEST_N + DEV_N], ["test", "dev", "train"]).select(
        "doc_id", "label", "rn", "split")


# ------------------------------------------------------------------ vectors
@register("mean_vector", ids="A17", sql="""
SELECT label, dim, round(avg(x), 6) AS mean FROM
  (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS dim
   FROM embeddings) GROUP BY label, dim""")
def mean_vector(spark, sf_dir):
    return VC.mean_vector(Tables(spark, sf_dir)["embeddings"], "label", "embedding")


@register("standardize", ids="M4", sql="""
WITH l AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS dim
           FROM embeddings),
s AS (SELECT dim, avg(x) AS mu, stddev_pop(x) AS sd FROM l GROUP BY dim)
SELECT vec_id, l.dim, round(CASE WHEN sd = 0 THEN 0.0 ELSE (x - mu) / sd END, 6) AS z FROM l JOIN s ON s.dim = l.dim""")
def standardize(spark, sf_dir):
    return VC.standardize(Tables(spark, sf_dir)["embeddings"], "vec_id", "embedding")


def _hash32(word):
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long")


# Words hash into twice the range of the table's ids, so all vectors can be met and
# about half of the words are unknown.
@register("known_vector_mean", ids="J10 J12 M2", sql=f"""
WITH m AS (SELECT 2 * (max(vec_id) + 1) AS n FROM embeddings),
ex AS (SELECT doc_id, unnest({TOK}) AS word FROM documents),
k AS (SELECT ex.doc_id, e.embedding FROM ex, m JOIN embeddings e
        ON e.vec_id = CAST(('0x' || substr(md5(ex.word), 1, 8)) AS BIGINT) % m.n),
n AS (SELECT doc_id, count(*) AS n_known FROM k GROUP BY doc_id),
l AS (SELECT doc_id, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS dim FROM k)
SELECT l.doc_id, dim, round(avg(x), 6) AS mean, any_value(n_known) AS n_known
FROM l JOIN n ON n.doc_id = l.doc_id GROUP BY l.doc_id, dim""")
def known_vector_mean(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = _docs(t)
    vecs = t["embeddings"].select(F.col("vec_id"), F.col("embedding"))
    n = vecs.agg((F.max("vec_id") + 1) * 2).scalar()
    return VC.known_vector_mean(d, "doc_id", "words", vecs, "vec_id", "embedding",
                                word_fn=lambda w: F.pmod(_hash32(w), n)).select("doc_id", "dim", "mean", "n_known")


@register("polygon_lines", ids="S20 W8", sql="""
WITH v AS (SELECT vec_id, CAST(unnest(range(0, len(embedding) // 2)) AS INTEGER) AS i, embedding FROM embeddings)
SELECT CAST(-1 AS BIGINT) AS area_ord, 0 AS kind, 0 AS i, 'Polygon' AS line
UNION ALL SELECT vec_id, 0, 0, CAST(vec_id AS VARCHAR) || ' 0' FROM embeddings
UNION ALL SELECT vec_id, 1, i, CAST(i AS VARCHAR) || ' ' || printf('%.6f', CAST(embedding[2 * i + 2] AS DOUBLE)) || ' ' ||
                 printf('%.6f', CAST(embedding[2 * i + 1] AS DOUBLE)) || ' 1.#QNAN 1.#QNAN' FROM v
UNION ALL SELECT CAST(4611686018427387904 AS BIGINT), 2, 0, 'END'""")
def polygon_lines(spark, sf_dir):
    e = Tables(spark, sf_dir)["embeddings"]
    areas = e.select(F.col("vec_id"), F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1), lambda i: F.struct(
        F.col("embedding")[i * 2].alias("lat"), F.col("embedding")[i * 2 + 1].alias("lng"))).alias("path"))
    return VC.polygon_lines(areas, "vec_id", "path")


# ------------------------------------------------------------------ evaluation
def _scored(t):
    j = t["documents"].select("doc_id", "n_chars").join(_labels(t), "doc_id")
    return j.select("doc_id", "label", F.col("n_chars").alias("score"),
                    (F.col("n_chars") > 2000).cast("int").alias("prediction"))


SQL_SCORED = """WITH s AS (SELECT d.doc_id, l.quality AS label, d.n_chars AS score,
  CAST(d.n_chars > 2000 AS INTEGER) AS prediction FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
SQL_ROC = SQL_SCORED + """,
per AS (SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS d_tp, count(*) FILTER (WHERE label <> 1) AS d_fp
        FROM s GROUP BY score),
tot AS (SELECT count(*) FILTER (WHERE label = 1) AS "P", count(*) FILTER (WHERE label <> 1) AS "N" FROM s),
run AS (SELECT *, sum(d_tp) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tp,
               sum(d_fp) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fp FROM per),
roc AS (SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / "P", 6) AS tpr,
               round(fp / "N", 6) AS fpr, d_tp, d_fp, "P", "N" FROM run, tot)"""


@register("confusion", ids="A18", sql=SQL_SCORED + "\nSELECT label, prediction, count(*) AS n FROM s GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return EV.confusion(_scored(Tables(spark, sf_dir)))


@register("accuracy", ids="A19 M8", sql=SQL_SCORED + """
SELECT count(*) AS n, round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy FROM s""")
def accuracy(spark, sf_dir):
    return EV.accuracy(_scored(Tables(spark, sf_dir)))


@register("roc_points", ids="A20", sql=SQL_ROC + "\nSELECT * FROM roc")
def roc_points(spark, sf_dir):
    return EV.roc_points(_scored(Tables(spark, sf_dir)))


@register("auc", ids="A21", sql=SQL_ROC + """
SELECT round(sum((fp / "N" - (fp - d_fp) / "N") * (tp / "P" + (tp - d_tp) / "P") / 2), 6) AS auc,
       count(*) AS n_thresholds FROM roc""")
def auc(spark, sf_dir):
    return EV.auc(_scored(Tables(spark, sf_dir)))


# ------------------------------------------------------------------ Naive Bayes
SQL_NB_BASE = SQL_WORD_SCORES + f""",
best AS (SELECT word FROM s ORDER BY score DESC, word LIMIT {K_BEST}),
lab AS ({LABELLED_SQL}),
nc AS (SELECT label, count(*) AS n_c FROM lab GROUP BY label),
ntot AS (SELECT count(*) AS n_docs FROM lab),
prior AS (SELECT label, ln(n_c + 1.0) - ln(n_docs + 2.0) AS lp FROM nc, ntot),
alld AS (SELECT doc_id, {TOK} AS w FROM documents)"""

SQL_BERNOULLI = SQL_NB_BASE + """,
tw AS (SELECT DISTINCT lab.doc_id, lab.label, x.word FROM lab, unnest(lab.w) AS x(word) JOIN best ON best.word = x.word),
dfw AS (SELECT label, word, count(*) AS df FROM tw GROUP BY 1, 2),
theta AS (SELECT nc.label, best.word, ln(coalesce(dfw.df, 0) + 1.0) - ln(nc.n_c + 2.0) AS lt
          FROM nc CROSS JOIN best LEFT JOIN dfw ON dfw.label = nc.label AND dfw.word = best.word),
th AS (SELECT label, word, lt, ln(1 - exp(lt)) AS lnt FROM theta),
base AS (SELECT th.label, any_value(prior.lp) + sum(lnt) AS b FROM th JOIN prior ON prior.label = th.label GROUP BY th.label),
dw AS (SELECT DISTINCT alld.doc_id, x.word FROM alld, unnest(alld.w) AS x(word) JOIN best ON best.word = x.word),
sc AS (SELECT dw.doc_id, th.label, sum(th.lt - th.lnt) AS s FROM dw JOIN th ON th.word = dw.word GROUP BY 1, 2),
ll AS (SELECT d.doc_id, base.label, base.b + coalesce(sc.s, 0) AS v FROM documents d CROSS JOIN base
       LEFT JOIN sc ON sc.doc_id = d.doc_id AND sc.label = base.label),
p AS (SELECT doc_id, max(v) FILTER (WHERE label = 1) AS l1, max(v) FILTER (WHERE label = 0) AS l0 FROM ll GROUP BY doc_id)
SELECT doc_id, round(1 / (1 + exp(l0 - l1)), 6) AS p_pos, CAST(l1 > l0 AS INTEGER) AS prediction FROM p"""

SQL_MULTINOMIAL = SQL_NB_BASE + f""",
tw AS (SELECT lab.label, x.word FROM lab, unnest(lab.w) AS x(word) JOIN best ON best.word = x.word),
cw AS (SELECT label, word, count(*) AS c FROM tw GROUP BY 1, 2),
tc AS (SELECT label, count(*) AS total FROM tw GROUP BY 1),
theta AS (SELECT nc.label, best.word, ln(coalesce(cw.c, 0) + 1.0) - ln(coalesce(tc.total, 0) + {K_BEST}.0) AS lt
          FROM nc CROSS JOIN best LEFT JOIN cw ON cw.label = nc.label AND cw.word = best.word
          LEFT JOIN tc ON tc.label = nc.label),
dw AS (SELECT alld.doc_id, x.word, count(*) AS n FROM alld, unnest(alld.w) AS x(word) JOIN best ON best.word = x.word GROUP BY 1, 2),
sc AS (SELECT dw.doc_id, theta.label, sum(dw.n * theta.lt) AS s FROM dw JOIN theta ON theta.word = dw.word GROUP BY 1, 2),
ll AS (SELECT d.doc_id, prior.label, prior.lp + coalesce(sc.s, 0) AS v FROM documents d CROSS JOIN prior
       LEFT JOIN sc ON sc.doc_id = d.doc_id AND sc.label = prior.label),
p AS (SELECT doc_id, max(v) FILTER (WHERE label = 1) AS l1, max(v) FILTER (WHERE label = 0) AS l0 FROM ll GROUP BY doc_id)
SELECT doc_id, round(1 / (1 + exp(l0 - l1)), 6) AS p_pos, CAST(l1 > l0 AS INTEGER) AS prediction FROM p"""


def _nb(spark, sf_dir, model_type):
    t = Tables(spark, sf_dir)
    lab = _labelled(t)
    vocab = FT.best_words(FT.class_scores(lab, "words", "label"), K_BEST)
    return ML.naive_bayes_scores(lab, _docs(t), "doc_id", "words", "label", vocab, model_type)


@register("bernoulli_nb_scores", ids="M9 M18", sql=SQL_BERNOULLI)
def bernoulli_nb_scores(spark, sf_dir):
    return _nb(spark, sf_dir, "bernoulli")


@register("multinomial_nb_scores", ids="M10 M18", sql=SQL_MULTINOMIAL)
def multinomial_nb_scores(spark, sf_dir):
    return _nb(spark, sf_dir, "multinomial")
