"""Readers and sinks round trips in fresh temp directories."""

import json
import os

import pytest
from pyspark.sql import functions as F

from roamlens import schemas as S
from roamlens.operators import vectors as VC
from roamlens.sources import readers as RD
from roamlens.sources import sinks as SK


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_lines_and_documents(spark, tmp):
    d = os.path.join(tmp, "docs")
    os.makedirs(d)
    _write(os.path.join(d, "a.txt"), "\n  first line \n\nsecond\n")
    _write(os.path.join(d, "b.txt"), "")
    lines = RD.read_lines(spark, d)
    assert sorted(r.value for r in lines.collect()) == ["first line", "second"]
    docs = RD.read_documents(spark, d).withColumn("first", RD.first_nonblank_line("text"))
    got = {os.path.basename(r.path): r.first for r in docs.collect()}
    assert got["a.txt"] == "  first line "
    assert got.get("b.txt") is None


def test_lexicon_reader(spark, tmp):
    for n, t in [("sen.txt", "好 2.0\n差 -1.5\n好 3.0\n"), ("not.txt", "不\n没有\n"), ("deg.txt", "很 1.5\n不 2.0\n")]:
        _write(os.path.join(tmp, n), t)
    from roamlens.operators.lexicon import merge_lexicon
    lex = RD.read_lexicon(spark, os.path.join(tmp, "sen.txt"), os.path.join(tmp, "not.txt"),
                          os.path.join(tmp, "deg.txt"))
    m = {r.word: (r.kind, r.weight) for r in merge_lexicon(lex).collect()}
    assert m == {"好": ("sen", 3.0), "差": ("sen", -1.5), "不": ("deg", 2.0), "没有": ("not", -1.0), "很": ("deg", 1.5)}


def test_gazetteer_text_and_json(spark, tmp):
    _write(os.path.join(tmp, "g.txt"), "/广西/南宁: 青秀 兴宁\n桂林: 阳朔 临桂\n \n/四川/成都: 武侯 阳朔\n")
    m = RD.read_gazetteer_text(spark, os.path.join(tmp, "g.txt")).first().value
    assert m == {"广西": {"南宁": ["青秀", "兴宁"], "桂林": ["阳朔", "临桂"]}, "四川": {"成都": ["武侯", "阳朔"]}}
    from roamlens.operators.fuzzy import flatten_gazetteer_map
    flat_text = flatten_gazetteer_map(RD.read_gazetteer_text(spark, os.path.join(tmp, "g.txt")), "value")
    assert [r.name for r in flat_text.orderBy("ord").collect()][:3] == ["广西", "南宁", "青秀"]
    _write(os.path.join(tmp, "g_map.json"), '{"广西": {"南宁": ["青秀", "兴宁"], "桂林": ["阳朔", "临桂"]}, '
                                             '"四川": {"成都": ["武侯", "阳朔"]}}')
    lst = [{"广西": [{"南宁": ["青秀", "兴宁"]}, {"桂林": ["阳朔", "临桂"]}]}, {"四川": [{"成都": ["武侯", "阳朔"]}]}]
    _write(os.path.join(tmp, "g_list.json"), json.dumps(lst, ensure_ascii=False))
    _write(os.path.join(tmp, "g_maps.json"), json.dumps(
        [{"广西": {"南宁": ["青秀", "兴宁"], "桂林": ["阳朔", "临桂"]}}, {"四川": {"成都": ["武侯", "阳朔"]}}], ensure_ascii=False))
    _write(os.path.join(tmp, "g_bad.json"), '{"a": 1}')
    with pytest.raises(ValueError):
        RD.read_gazetteer_json(spark, os.path.join(tmp, "g_bad.json"))
    from roamlens.operators.fuzzy import name_to_province
    for f in ["g_map.json", "g_list.json", "g_maps.json"]:
        flat = RD.read_gazetteer_json(spark, os.path.join(tmp, f))
        rows = flat.orderBy("ord").collect()
        assert [r.name for r in rows] == ["广西", "南宁", "青秀", "兴宁", "桂林", "阳朔", "临桂", "四川", "成都", "武侯", "阳朔"]
        n2p = {r.name: r.province for r in name_to_province(flat).collect()}
        assert n2p["阳朔"] == "广西" and n2p["武侯"] == "四川"


def test_json_sink_keeps_unicode(spark, tmp):
    df = spark.createDataFrame([("桂林", None)], "name string, x string")
    SK.write_json(df, os.path.join(tmp, "j"))
    text = "".join(open(os.path.join(tmp, "j", f), encoding="utf-8").read()
                   for f in os.listdir(os.path.join(tmp, "j")) if f.endswith(".json"))
    assert "桂林" in text


def test_names_scores_polygon_sinks(spark, tmp):
    df = spark.createDataFrame([("a",), ("",), (None,), ("b",)], "n string")
    SK.write_names(df, "n", os.path.join(tmp, "names"))
    assert sorted(r.value for r in spark.read.text(os.path.join(tmp, "names")).collect()) == ["a", "b"]
    sc = spark.createDataFrame([(2, 0.25, 0.75), (1, 0.9, 0.1)], "doc_id long, p_pos double, p_neg double")
    SK.write_scores(sc, "doc_id", "p_pos", "p_neg", os.path.join(tmp, "scores"))
    assert sorted(r.value for r in spark.read.text(os.path.join(tmp, "scores", "text")).collect()) == ["0.25 0.75", "0.9 0.1"]
    areas = spark.createDataFrame([("7", [(1.5, 2.5)]), ("8", [])], S.SCENE_AREA)
    SK.write_polygon(VC.polygon_lines(areas, "area_id", "area_paths", fmt="%.1f"), os.path.join(tmp, "poly"))
    parts = sorted(f for f in os.listdir(os.path.join(tmp, "poly")) if f.startswith("part-"))
    lines = [l.rstrip("\n") for p in parts for l in open(os.path.join(tmp, "poly", p), encoding="utf-8")]
    assert lines == ["Polygon", "7 0", "0 2.5 1.5 1.#QNAN 1.#QNAN", "8 0", "END"]


def test_scene_areas_and_labelled_tokens(spark, tmp):
    _write(os.path.join(tmp, "areas.json"), '{"area_id": "1", "area_paths": [{"lat": 1.0, "lng": 2.0}]}\n'
                                            '{"area_id": "2", "area_paths": []}\n')
    a = RD.read_scene_areas(spark, os.path.join(tmp, "areas.json"))
    assert {r.area_id: len(r.area_paths) for r in a.collect()} == {"1": 1, "2": 0}
    lt = spark.createDataFrame([(1, 1, ["a"]), (2, 0, [])], S.LABELLED_TOKENS)
    lt.write.parquet(os.path.join(tmp, "lt"))
    assert RD.read_labelled_tokens(spark, os.path.join(tmp, "lt")).count() == 2


def test_append_comments(spark, tmp):
    df = spark.createDataFrame([("p1", "t1"), ("p2", "t2")], "poi_id string, comment_text string")
    SK.append_comments(df, os.path.join(tmp, "idx"), buckets=4)
    SK.append_comments(df, os.path.join(tmp, "idx"), buckets=4)
    assert spark.read.parquet(os.path.join(tmp, "idx")).count() == 4


def test_model_roundtrip(spark, tmp):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import CountVectorizerModel
    df = spark.createDataFrame([(["good", "fun"], 1.0), (["bad"], 0.0), (["good"], 1.0), (["bad", "sad"], 0.0)],
                               "words array<string>, label double")
    cv = CountVectorizerModel.from_vocabulary(["good", "fun", "bad", "sad"], inputCol="words",
                                              outputCol="features", binary=True)
    m = Pipeline(stages=[cv, NaiveBayes(modelType="bernoulli")]).fit(df)
    m.write().overwrite().save(os.path.join(tmp, "m"))
    p = PipelineModel.load(os.path.join(tmp, "m")).transform(df)
    assert [r.prediction for r in p.collect()] == [1.0, 0.0, 1.0, 0.0]
