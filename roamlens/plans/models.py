"""Model queries.  The naive Bayes parts have an
oracle; MLlib's iterative fits have no SQL equivalent and are rows-only."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from roamlens.functions.columns import round6
from roamlens.operators import bayes as BY
from roamlens.operators import embedding as EM
from roamlens.operators import evaluation as EV
from roamlens.operators import features as FT
from roamlens.operators import ml as ML
from roamlens.operators import sampling as SM
from roamlens.operators import vectors as VC
from roamlens.operators.kernel import RandomFourierSVC
from roamlens.plans.registry import register
from roamlens.plans.standins import Tables
from roamlens.plans.textmining import K_BEST, LABELLED_SQL, TOK, _docs, _labelled, chi_sql
from roamlens.session import cut_lineage, scratch_path

SWEEP = [500, 1000, 1500, 2000, 2500, 3000]


def _split_labelled(t):
    lab = _labelled(t).withColumn("feats", FT.word_and_bigram_features("words"))
    return SM.hash_split(lab, "doc_id", 1, 0.6)


def _vectorise(df, col, vocab):
    return ML.vocabulary_vectors(df, col, vocab, binary=True).withColumn("label", F.col("label").cast("double"))


def _predictions(model, test):
    p = model.transform(test)
    return p.select("doc_id", F.col("label").cast("int").alias("label"),
                    F.col("prediction").cast("int").alias("prediction"))


@register("w2v_vectors", ids="M1 M2 N18")
def w2v_vectors(spark, sf_dir):
    d = _docs(Tables(spark, sf_dir)).select("doc_id", "words")
    return ML.word2vec_sentence_vectors(d, "doc_id", "words", vector_size=100, seed=1)


VECTOR_DIM, VECTOR_WINDOW, VECTOR_MIN, VECTOR_PCA = 64, 2, 5, 32


@register("document_vectors", ids="M1 M2 J10", sql=f"""
WITH t AS (SELECT doc_id, {TOK} AS w FROM documents),
ex AS (SELECT doc_id, unnest(w) AS word FROM t),
cn AS (SELECT word, count(*) AS c FROM ex GROUP BY 1),
tot AS (SELECT sum(c) AS total FROM cn),
known AS (SELECT word, ln(total / c) AS rare FROM cn, tot WHERE c >= {VECTOR_MIN}),
one AS (SELECT w[i] AS word, w[i + k] AS other FROM (SELECT w, k, unnest(generate_series(1, len(w) - k)) AS i
        FROM t, (SELECT unnest(range(1, {VECTOR_WINDOW + 1})) AS k) WHERE len(w) > k)),
nb AS (SELECT word, other, count(*) AS n FROM (SELECT word, other FROM one UNION ALL SELECT other, word FROM one) GROUP BY 1, 2),
sg AS (SELECT word AS other, d, rare * (((CAST('0x' || substr(md5(word), d // 4 + 1, 1) AS INTEGER) >> (d % 4)) & 1) * 2 - 1) AS s
       FROM known, (SELECT CAST(unnest(range(0, {VECTOR_DIM})) AS INTEGER) AS d)),
v AS (SELECT nb.word, d, sum(n * s) AS x FROM nb JOIN sg USING (other) JOIN known ON known.word = nb.word GROUP BY 1, 2),
nv AS (SELECT word, d, x / sqrt(sum(x * x) OVER (PARTITION BY word)) AS x FROM v),
m AS (SELECT doc_id, d AS dim, round(avg(x), 6) + 0.0 AS mean, count(*) AS n_known FROM ex JOIN nv USING (word) GROUP BY 1, 2)
SELECT * FROM m""")
def document_vectors(spark, sf_dir):
    """Mean of the co-occurrence vectors of each document's known words."""
    d = _docs(Tables(spark, sf_dir)).select("doc_id", "words")
    vecs = EM.word_vectors(d, "words", VECTOR_DIM, VECTOR_WINDOW, VECTOR_MIN)
    return VC.known_vector_mean(d, "doc_id", "words", vecs, "word", "vec")


@register("embedding_chain", ids="M1 M2 M3 M4 M5 M6 M7 M8 A20 A21")
def embedding_chain(spark, sf_dir):
    """The embedding sentiment chain on the labelled documents: word vectors, their mean,
    scaling, projection, kernel classifier; accuracy and AUC on the held-out part."""
    t = Tables(spark, sf_dir)
    docs = _docs(t).select("doc_id", "words")
    means = VC.known_vector_mean(docs, "doc_id", "words", EM.word_vectors(docs, "words", VECTOR_DIM, VECTOR_WINDOW, VECTOR_MIN), "word", "vec")
    wide = means.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("vec"))
    lab = cut_lineage(wide.join(t["labels"].select("doc_id", F.col("quality").alias("label")), "doc_id"))
    s = SM.hash_split(lab, "doc_id", 1, 0.6).withColumn("y", F.col("label").cast("double"))
    train, test = s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")
    _, scaled = ML.scale_and_project(train, "vec", k=VECTOR_PCA)  # fitted on the training part alone
    vector = lambda df: scaled.transform(df.withColumn("__vec", array_to_vector("vec"))).withColumnRenamed("__p", "features")
    out = RandomFourierSVC(labelCol="y", maxIter=100).fit(vector(train)).transform(vector(test))
    scored = cut_lineage(out.select("label", F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability")[1].alias("score")))
    return EV.auc(scored).join(EV.accuracy(scored))


@register("pca_project", ids="M4 M5")
def pca_project(spark, sf_dir):
    e = Tables(spark, sf_dir)["embeddings"]
    out, _ = ML.scale_and_project(e, "embedding", k=100)
    return out.select("vec_id", "label", F.transform("pca", lambda x: F.round(x, 6)).alias("pca"))


def _best_vocab(train, k=K_BEST):
    return ML.collect_vocabulary(FT.best_words(FT.class_scores(train, "feats", "label"), k))


def _best_vectors(t):
    """Training and test part over the best features of the training part, as vectors that
    are written once: a fit reads its rows several times, and each would cut all texts again."""
    s = _split_labelled(t)
    train = s.filter(F.col("split") == "train")
    vocab = ML.collect_vocabulary(FT.best_words(FT.word_and_bigram_class_scores(train, "words", "label"), K_BEST))
    v = cut_lineage(_vectorise(s, "feats", vocab).select("doc_id", "label", "split", "features"))
    return v.filter(F.col("split") == "train"), v.filter(F.col("split") == "test")


@register("logreg_eval", ids="M11 M14 A19")
def logreg_eval(spark, sf_dir):
    train, test = _best_vectors(Tables(spark, sf_dir))
    return _predictions(LogisticRegression(maxIter=50).fit(train), test)


@register("linear_svc_eval", ids="M12 M14")
def linear_svc_eval(spark, sf_dir):
    train, test = _best_vectors(Tables(spark, sf_dir))
    return _predictions(LinearSVC(maxIter=50, regParam=0.01).fit(train), test)


def _rbf_scored(t):
    """The embeddings' test rows by the kernel classifier: standardise + PCA, random
    Fourier features, linear SVM, probability from a logistic fit on its margin."""
    e = t["embeddings"].withColumn("y", (F.col("label") >= 5).cast("double"))
    z, _ = ML.scale_and_project(e, "embedding", k=100)
    f = SM.hash_split(z.withColumn("features", array_to_vector("pca")), "vec_id", 1, 0.6)
    model = RandomFourierSVC(labelCol="y", maxIter=100).fit(f.filter(F.col("split") == "train"))
    return model.transform(f.filter(F.col("split") == "test"))


@register("rbf_svc_eval", ids="M7 M13 M6 M8")
def rbf_svc_eval(spark, sf_dir):
    out = _rbf_scored(Tables(spark, sf_dir))
    return out.select("vec_id", F.col("y").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"),
                      round6(vector_to_array("probability")[1]).alias("p_pos"))


@register("rbf_auc", ids="M7 A20 A21")
def rbf_auc(spark, sf_dir):
    """AUC and accuracy of the kernel classifier's probabilities."""
    out = cut_lineage(_rbf_scored(Tables(spark, sf_dir)).select(
        F.col("y").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability")[1].alias("score")))
    return EV.auc(out).join(EV.accuracy(out))


# ------------------------------------------------------------------ the grid
def _grid_features(t):
    """The labelled documents with their word, bigram and joint features, split."""
    return _split_labelled(t).withColumn("bigr", FT.bigram_strings("words"))


def _methods(table, s):
    """The feature table with a flag for each method's features, and the methods."""
    tr = s.filter(F.col("split") == "train")
    flag = {"best_w": FT.best_words(FT.class_scores(tr, "words", "label"), K_BEST),
            "best_wb": FT.best_words(FT.class_scores(tr, "feats", "label"), K_BEST),
            "best_b": FT.best_words(FT.class_scores(tr, "bigr", "label"), GRID_BIGRAMS)}
    for name, best in flag.items():
        table = table.join(best.select("word", F.lit(True).alias(name)), "word", "left")
    is_word = ~F.contains("word", F.lit("_"))  # tokens hold letters only
    on = lambda c: F.coalesce(c, F.lit(False))
    return table, {"bag_of_words": is_word, "bigrams_top1000": on("best_b"), "words_and_bigrams": F.lit(True),
                   "best_words": on("best_w"), "best_words_and_bigrams": on("best_wb")}


def _nb_accuracies(s, table, sets, few=False):
    """Both naive Bayes models over all feature sets: one table of statistics (``few``:
    of a bounded number of features), one scoring pass."""
    test = s.filter(F.col("split") == "test")
    scored = BY.margins(test, "doc_id", "feats", table, BY.set_totals(table, sets), sets, keep=("label",), few=few)
    name = F.when(F.col("model") == "bernoulli", "BernoulliNB").otherwise("MultinomialNB")
    return BY.accuracies(scored, "label").select("method", name.alias("classifier"), round6("accuracy").alias("accuracy"))


def _nb_grid(s):
    table, sets = _methods(BY.feature_table(s.filter(F.col("split") == "train"), "label", "feats"), s)
    return _nb_accuracies(s, cut_lineage(table), sets)


GRID_BIGRAMS = 1000

_CLASSES = f"""
lab AS ({LABELLED_SQL}),
f AS (SELECT doc_id, label, w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1]) AS b,
             CASE WHEN CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':1'), 1, 8)) AS BIGINT) % 10000 < 6000
                  THEN 'train' ELSE 'test' END AS split FROM lab)"""


def _best_sql(name: str, rows: str, features: str, k: int) -> str:
    """CTEs: the k features of ``rows`` that tell the classes best, with their rank."""
    return f"""
{name}_t AS (SELECT label, unnest({features}) AS word FROM {rows}),
{name}_c AS (SELECT word, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_pos FROM {name}_t GROUP BY word),
{name}_n AS (SELECT count(*) AS big_n, count(*) FILTER (WHERE label = 1) AS big_p FROM {name}_t),
{name} AS (SELECT word, row_number() OVER (ORDER BY round({chi_sql('n_pos', 'n', 'big_p', 'big_n')}
             + {chi_sql('n - n_pos', 'n', 'big_n - big_p', 'big_n')}, 6) DESC, word) AS place FROM {name}_c, {name}_n
           QUALIFY place <= {k})"""


def _nb_sql(members: str, train: str = "split = 'train'", test: str = "split = 'test'") -> str:
    """CTEs from ``f``: the statistics of the training rows, ``members`` (method, word),
    and ``ll`` (method, doc_id, label, the two margins) of the tested rows."""
    return f"""
ex AS (SELECT DISTINCT doc_id, label, split, unnest(list_concat(w, b)) AS word FROM f),
st AS (SELECT word, count(*) FILTER (WHERE label = 1) AS c1, count(*) FILTER (WHERE label <> 1) AS c0 FROM ex WHERE {train} GROUP BY 1),
nn AS (SELECT count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label <> 1) AS n0 FROM f WHERE {train}),
me AS ({members}),
mm AS (SELECT method, word, c1, c0, ln((c1 + 1) / (n1 + 2)) AS p1, ln((c0 + 1) / (n0 + 2)) AS p0,
              ln(1 - (c1 + 1) / (n1 + 2)) AS a1, ln(1 - (c0 + 1) / (n0 + 2)) AS a0 FROM me JOIN st USING (word), nn),
tot AS (SELECT method, sum(a1 - a0) AS absent, ln(sum(c1) + count(*)) - ln(sum(c0) + count(*)) AS size FROM mm GROUP BY 1),
sc AS (SELECT method, doc_id, sum(p1 - a1 - p0 + a0) AS bern, sum(ln(c1 + 1) - ln(c0 + 1)) AS multi, count(*) AS k
       FROM ex JOIN mm USING (word) WHERE {test} GROUP BY 1, 2),
ll AS (SELECT tot.method, f.doc_id, f.label, ln(n1 + 1) - ln(n0 + 1) + absent + coalesce(bern, 0) AS bern,
              ln(n1 + 1) - ln(n0 + 1) + coalesce(multi, 0) - coalesce(k, 0) * size AS multi
       FROM f CROSS JOIN tot CROSS JOIN nn LEFT JOIN sc ON sc.doc_id = f.doc_id AND sc.method = tot.method WHERE {test})"""


SQL_NB_GRID = f"""WITH {_CLASSES},
tr AS (SELECT * FROM f WHERE split = 'train'),{_best_sql('bw', 'tr', 'w', K_BEST)},{_best_sql('bb', 'tr', 'b', GRID_BIGRAMS)},
{_best_sql('bwb', 'tr', 'list_concat(w, b)', K_BEST)},{_nb_sql("""
  SELECT 'bag_of_words' AS method, word FROM st WHERE NOT contains(word, '_') UNION ALL SELECT 'words_and_bigrams', word FROM st
  UNION ALL SELECT 'bigrams_top1000', word FROM bb UNION ALL SELECT 'best_words', word FROM bw
  UNION ALL SELECT 'best_words_and_bigrams', word FROM bwb""")}
SELECT method, 'BernoulliNB' AS classifier, round(avg(CAST((bern > 0) = (label = 1) AS DOUBLE)), 6) AS accuracy FROM ll GROUP BY 1
UNION ALL SELECT method, 'MultinomialNB', round(avg(CAST((multi > 0) = (label = 1) AS DOUBLE)), 6) FROM ll GROUP BY 1"""


@register("nb_grid", ids="M15 M9 M10 F2", sql=SQL_NB_GRID)
def nb_grid(spark, sf_dir):
    """The naive Bayes rows of the grid."""
    return _nb_grid(cut_lineage(_grid_features(Tables(spark, sf_dir))))


@register("classifier_grid", ids="M15 M14 F2 F3 M13")
def classifier_grid(spark, sf_dir):
    t = Tables(spark, sf_dir)
    s = cut_lineage(_grid_features(t))  # five vocabularies and feature sets are built from it
    tr = s.filter(F.col("split") == "train")
    best_w = ML.collect_vocabulary(FT.best_words(FT.class_scores(tr, "words", "label"), K_BEST))
    best_wb = _best_vocab(tr)
    best_b = ML.collect_vocabulary(FT.best_words(FT.class_scores(tr, "bigr", "label"), GRID_BIGRAMS))

    def chosen(col, vocab):
        v = _vectorise(s, col, vocab).select("label", "features", "split")
        return v.filter(F.col("split") == "train"), v.filter(F.col("split") == "test")

    def every(col):
        return ML.whole_vocabulary_vectors(s, "doc_id", col, "label", "split", scratch_path(spark, "grid_features"))

    sets = {
        "bag_of_words": every("words"),
        "bigrams_top1000": chosen("bigr", best_b),
        "words_and_bigrams": every("feats"),
        "best_words": chosen("words", best_w),
        "best_words_and_bigrams": chosen("feats", best_wb),
    }
    rows = spark.createDataFrame(ML.grid(sets, ML.classifiers()), "method string, classifier string, accuracy double")
    return rows.unionByName(_nb_grid(s))


# ------------------------------------------------------------------ the sweep
def _ranked_features(s, k):
    best = FT.best_words(FT.class_scores(s.filter(F.col("split") == "train"), "feats", "label"), k)
    return best.select("word", F.row_number().over(Window.orderBy(F.desc("score"), "word")).alias("place"))  # k rows


def _nb_sweep(s, ranked):
    """All dimensions read off one scoring pass: the features of dimension k are those
    of place up to k."""
    table = BY.feature_table(s.filter(F.col("split") == "train"), "label", "feats", only=ranked.select("word")).join(F.broadcast(ranked), "word")
    found = _nb_accuracies(s, cut_lineage(table), {str(k): F.col("place") <= k for k in SWEEP}, few=True)
    return found.select(F.col("method").cast("int").alias("dimension"), "classifier", "accuracy")


SQL_NB_SWEEP = f"""WITH {_CLASSES},
tr AS (SELECT * FROM f WHERE split = 'train'),{_best_sql('best', 'tr', 'list_concat(w, b)', max(SWEEP))},
dims AS (SELECT unnest({SWEEP}) AS d),{_nb_sql("SELECT d AS method, word FROM best JOIN dims ON place <= d")}
SELECT method AS dimension, 'BernoulliNB' AS classifier, round(avg(CAST((bern > 0) = (label = 1) AS DOUBLE)), 6) AS accuracy FROM ll GROUP BY 1
UNION ALL SELECT method, 'MultinomialNB', round(avg(CAST((multi > 0) = (label = 1) AS DOUBLE)), 6) FROM ll GROUP BY 1"""


@register("nb_dimension_sweep", ids="M16 M9 M10 T2", sql=SQL_NB_SWEEP)
def nb_dimension_sweep(spark, sf_dir):
    """The naive Bayes rows of the sweep."""
    s = cut_lineage(_split_labelled(Tables(spark, sf_dir)))
    return _nb_sweep(s, cut_lineage(_ranked_features(s, max(SWEEP))))


@register("dimension_sweep", ids="M16 T2 M13")
def dimension_sweep(spark, sf_dir):
    """Features ranked once; naive Bayes reads all dimensions off one pass, the other
    classifiers are refitted on prefixes of one vector whose places are the ranks."""
    s = cut_lineage(_split_labelled(Tables(spark, sf_dir)))
    ranked = cut_lineage(_ranked_features(s, max(SWEEP)))
    words = [r["word"] for r in ranked.orderBy("place").collect()]  # 3,000 words at most
    v = _vectorise(s, "feats", words).select("label", "features", "split").persist()

    def prefix(k):
        cut = VectorSlicer(inputCol="whole", outputCol="features", indices=list(range(min(k, len(words)))))
        rows = cut.transform(v.withColumnRenamed("features", "whole")).select("label", "features", "split")
        return rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "test")

    rows = [(int(k), c, a) for k, c, a in ML.grid({str(k): prefix(k) for k in SWEEP}, ML.classifiers())]
    v.unpersist()
    return spark.createDataFrame(rows, "dimension int, classifier string, accuracy double").unionByName(_nb_sweep(s, ranked))


# ------------------------------------------------------------------ the final evaluation
#: Training rows of each class; the rest is the test.  (The reference trains on 500 of
#: some 600; the smallest tables here hold about 200 of a class.)
FINAL_TRAIN = 100

SQL_NB_FINAL = f"""WITH lab AS ({LABELLED_SQL}),
f AS (SELECT doc_id, label, w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1]) AS b,
             CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR) || ':1'), doc_id) <= {FINAL_TRAIN}
                  THEN 'train' ELSE 'test' END AS split FROM lab),
tr AS (SELECT * FROM f WHERE split = 'train'),{_best_sql('best', 'tr', 'list_concat(w, b)', K_BEST)},{_nb_sql("SELECT 1 AS method, word FROM best")},
acc AS (SELECT round(avg(CAST((bern > 0) = (label = 1) AS DOUBLE)), 6) AS accuracy FROM ll),
lf AS (SELECT * FROM f),{_best_sql('fbest', 'lf', 'list_concat(w, b)', K_BEST)},
final AS (WITH f AS (
    SELECT doc_id, label, w, b, 'train' AS split FROM lf UNION ALL
    SELECT doc_id, NULL, w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1]), 'test'
    FROM (SELECT doc_id, {TOK} AS w FROM documents)),{_nb_sql("SELECT 1 AS method, word FROM fbest")}
  SELECT doc_id, bern FROM ll)
SELECT doc_id, round(1 / (1 + exp(-bern)), 6) AS p_pos, round(1 - 1 / (1 + exp(-bern)), 6) AS p_neg,
       printf('%.6f %.6f', round(1 / (1 + exp(-bern)), 6), round(1 - 1 / (1 + exp(-bern)), 6)) AS line,
       accuracy AS test_accuracy FROM final, acc"""


@register("nb_final_eval", ids="M17 M18 S22", sql=SQL_NB_FINAL)
def nb_final_eval(spark, sf_dir):
    """Bernoulli NB on the best features: the accuracy of a fit on the first rows of each
    class (seeded order) on all others; then a fit on all labelled rows, saved, loaded
    back and applied to every document."""
    t = Tables(spark, sf_dir)
    lab = cut_lineage(_labelled(t).withColumn("feats", FT.word_and_bigram_features("words")))
    first = SM.first_n_per_class(lab.select("doc_id", "label"), "label", "doc_id", FINAL_TRAIN, seed=1).select("doc_id")
    sets = {"best": F.lit(True)}

    def fit(rows):
        best = cut_lineage(FT.best_words(FT.class_scores(rows, "feats", "label"), K_BEST).select("word"))
        table = cut_lineage(BY.feature_table(rows, "label", "feats", only=best))
        return table, BY.set_totals(table, sets)

    def apply(model, rows, keep=()):
        return BY.margins(rows, "doc_id", "feats", *model, sets, models=("bernoulli",), keep=keep, few=True)

    tested = apply(fit(lab.join(first, "doc_id", "left_semi")), lab.join(first, "doc_id", "left_anti"), ("label",))
    accuracy = BY.accuracies(tested, "label").agg(round6(F.max("accuracy"))).scalar()
    path = scratch_path(spark, "nb_final")
    BY.save(*fit(lab), path)
    docs = _docs(t).withColumn("feats", FT.word_and_bigram_features("words"))
    p = BY.probability()
    scored = apply(BY.load(spark, path), docs).select("doc_id", round6(p).alias("p_pos"), round6(1 - p).alias("p_neg"))
    return scored.select("*", F.format_string("%.6f %.6f", "p_pos", "p_neg").alias("line"), accuracy.alias("test_accuracy"))
