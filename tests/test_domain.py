"""Hand-made domain fixtures (FIXTURES.md §B) and the worked expectations."""

import math

import pytest
from pyspark.sql import functions as F

from roamlens.functions.columns import chi_sq, numeric_stop, similarity, whitespace_to_commas, year_of, date_rest
from roamlens.operators import extract as X
from roamlens.operators import fuzzy as FZ
from roamlens.operators import simjoin as SJ
from roamlens.operators import lexicon as LX
from roamlens.operators import relational as R
from roamlens.operators import text as TX
from roamlens.operators import upsert as UP
from roamlens.operators import vectors as VC
from roamlens.operators.ordering import global_row_number, group_ordinal


def test_popularity_threshold(spark):
    rows = [("p10", i) for i in range(10)] + [("p11", i) for i in range(11)]
    c = spark.createDataFrame(rows, "poi_id string, i int")
    poi = spark.createDataFrame([("p10", "ten"), ("p11", "eleven"), ("p0", "none")], "poi_id string, name string")
    out = R.popular_join(poi, c, "poi_id", 10)
    assert {r.poi_id for r in out.collect()} == {"p11"}
    assert out.count() == 11


def test_page_fanout(spark):
    df = spark.createDataFrame([(1, "0"), (2, "1"), (3, "15"), (4, "16"), (5, None), (6, "")],
                               "id int, n string")
    got = {r.id: r.c for r in X.fan_out_pages(df, "n").groupBy("id").agg(F.count("*").alias("c")).collect()}
    assert got == {2: 1, 3: 1, 4: 2}


def test_year_split(spark):
    r = spark.createDataFrame([("2018-07-01 10:00:00",), ("20180701",)], "t string").select(
        year_of("t").alias("y"), date_rest("t").alias("rest")).collect()
    assert (r[0].y, r[0].rest) == ("2018", "07-01 10:00:00")
    assert (r[1].y, r[1].rest) == ("20180701", None)


def test_numeric_stop(spark):
    r = spark.createDataFrame([("7",), ("9999",), ("10000",), ("007",), ("0",), ("abc",)], "w string") \
        .select("w", numeric_stop("w").alias("s")).collect()
    assert {x.w: x.s for x in r} == {"7": True, "9999": True, "10000": False, "007": False, "0": True, "abc": False}


LEX = [("not", "not", 0.0, 1), ("a", "sen", 2.0, 2), ("b", "deg", 1.5, 3), ("no", "not", 0.0, 4),
       ("c", "sen", 3.0, 5), ("e", "sen", -1.0, 6)]


def test_lexicon_fold(spark):
    lex = spark.createDataFrame(LEX, "word string, kind string, weight double, ord int")
    d = spark.createDataFrame([(1, ["not", "a", "b", "no", "c", "o", "e"]), (2, ["b", "x"]), (3, [])],
                              "doc_id long, words array<string>")
    got = {r.doc_id: r.score for r in LX.lexicon_score(d, "doc_id", "words", lex).collect()}
    assert got == {1: -1.0, 2: 0.0, 3: 0.0}
    win = {r.doc_id: r.score for r in LX.lexicon_score_window(d, "doc_id", "words", lex).collect()}
    assert win == got


def test_lexicon_precedence_and_last_wins(spark):
    lex = spark.createDataFrame([("w", "sen", 1.0, 1), ("w", "not", 0.0, 2), ("w", "deg", 2.0, 3),
                                 ("s", "sen", 1.0, 4), ("s", "sen", 5.0, 5)],
                                "word string, kind string, weight double, ord int")
    m = {r.word: (r.kind, r.weight) for r in LX.merge_lexicon(lex).collect()}
    assert m == {"w": ("deg", 2.0), "s": ("sen", 5.0)}


def test_last_position(spark):
    d = spark.createDataFrame([(1, ["good", "bad", "good"])], "doc_id long, words array<string>")
    got = {r.word: r.pos for r in LX.last_positions(d, "doc_id", "words").collect()}
    assert got == {"good": 2, "bad": 1}


@pytest.mark.parametrize("scores,level", [((100, 100, 0), 1), ((50, 80, 80), 2), ((61, 60, 60), 1),
                                          ((60, 60, 60), None)])
def test_region_decision(spark, scores, level):
    r = spark.createDataFrame([scores], "p int, c int, k int").select(FZ.decide("p", "c", "k").alias("l")).first()
    assert r.l == level


def test_first_token(spark):
    df = spark.createDataFrame([("- ,桂林 南宁",), ("南宁",), (None,), ("-",), ("广西壮族自治区 桂林",)], "c string")
    got = [r.t for r in df.select(FZ.first_token("c").alias("t")).collect()]
    assert got == ["桂林", "南宁", None, None, "广西壮族自治区"]


def test_full_segmentation(spark):
    d = spark.createDataFrame([(1, "桂林两江四湖夜景很美")], "id long, text string")
    dic = spark.createDataFrame([("桂林",), ("两江四湖",), ("四湖",), ("夜景",), ("很美",)], "word string")
    got = [r.word for r in TX.dictionary_segments(d, "id", "text", dic).orderBy("start", "len").collect()]
    assert got == ["桂林", "两江四湖", "四湖", "夜景", "很美"]


def test_segmentation_uncovered_chars(spark):
    d = spark.createDataFrame([(1, "桂林的夜")], "id long, text string")
    dic = spark.createDataFrame([("桂林",)], "word string")
    got = [r.word for r in TX.dictionary_segments(d, "id", "text", dic).orderBy("start", "len").collect()]
    assert got == ["桂林", "的", "夜"]


def test_upsert_last_writer(spark):
    old = spark.createDataFrame([("k", "v1", 1), ("j", "x", 1)], "key string, val string, ingest_seq int")
    new = spark.createDataFrame([("k", "v2", 2)], "key string, val string, ingest_seq int")
    got = {r.key: r.val for r in UP.upsert(old, new, ["key"]).collect()}
    assert got == {"k": "v2", "j": "x"}


def test_upsert_versions_idempotent(spark, tmp):
    a = spark.createDataFrame([("k", "v1", 1)], "key string, val string, ingest_seq int")
    b = spark.createDataFrame([("k", "v2", 2), ("m", "z", 2)], "key string, val string, ingest_seq int")
    UP.upsert_to_path(spark, a, tmp, ["key"], version=1)
    UP.upsert_to_path(spark, b, tmp, ["key"], version=2)
    UP.upsert_to_path(spark, b, tmp, ["key"], version=2)  # replay: no-op
    got = {r.key: r.val for r in UP.current_version(spark, tmp).collect()}
    assert got == {"k": "v2", "m": "z"}


def test_whitespace_commas(spark):
    r = spark.createDataFrame([("a  b",), ("x y　z",)], "t string").select(
        whitespace_to_commas("t").alias("o")).collect()
    assert [x.o for x in r] == ["a,,b", "x,y,z"]


def test_polygon(spark):
    df = spark.createDataFrame([("7", [(1.5, 2.5)])], "area_id string, area_paths array<struct<lat:double,lng:double>>")
    lines = [r.line for r in VC.polygon_lines(df, "area_id", "area_paths", fmt="%.1f")
             .orderBy("area_ord", "kind", "i").collect()]
    assert lines == ["Polygon", "7 0", "0 2.5 1.5 1.#QNAN 1.#QNAN", "END"]


def test_chi_square_worked(spark):
    # class totals 6 / 4 of 10 tokens; the word occurs 3 times in class 1, once in class 0
    r = spark.range(1).select(
        (chi_sq(F.lit(3), F.lit(4), F.lit(6), F.lit(10)) + chi_sq(F.lit(1), F.lit(4), F.lit(4), F.lit(10)))
        .alias("s"), chi_sq(F.lit(3), F.lit(4), F.lit(6), F.lit(10)).alias("one")).first()
    assert math.isclose(r.one, 0.625) and math.isclose(r.s, 1.25)


def test_group_ordinal_hot_group(spark):
    rows = [("hot", i) for i in range(300)] + [("cold", i) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, o int")
    out = group_ordinal(df, ["g"], ["o"], num_partitions=8)
    got = {(r.g, r.o): r.rn for r in out.collect()}
    assert all(got[("hot", i)] == i + 1 for i in range(300))
    assert all(got[("cold", i)] == i + 1 for i in range(5))
    g = global_row_number(df, [F.desc("o"), "g"], num_partitions=8)
    assert sorted(r.rn for r in g.collect()) == list(range(1, 306))


def test_comment_blocks(spark):
    html = ('<ul><li class="rev-item comment-item clearfix"><a class="name" href="/u/40123456.html">n</a>'
            '<span class="s-star s-star5"></span><p class="rev-txt">很 好 看<br/>　!</p>'
            '<span class="time">2018-07-01 10:00:00</span></li>'
            '<li class="rev-item comment-item clearfix"><a class="name" href="/u/7.html">m</a>'
            '<span class="s-star s-star3"></span><p class="rev-txt">ok</p><span class="time">2019-01-02</span></li></ul>')
    df = spark.createDataFrame([(html,)], "html string")
    r = X.comment_blocks(df).orderBy("pos").collect()
    assert [(x.custom_id, x.comment_star, x.comment_time) for x in r] == [
        ("40123456", "5", "2018-07-01 10:00:00"), ("7", "3", "2019-01-02")]
    assert r[0].comment_text == "很,好,看,!"


def test_area_json_rows(spark):
    df = spark.createDataFrame([('{"0": {"name": "x"}, "12": {"name": "a", "mddid": "5", "price": "9", '
                                 '"lat": 1.0, "lng": 2.0, "paths": [{"lat": 1.0, "lng": 2.0}]}}',), ("[]",)], "body string")
    out = X.json_map_rows(df, "body", "struct<name:string,mddid:string,price:string,lat:double,lng:double,"
                                      "paths:array<struct<lat:double,lng:double>>>").collect()
    assert [(r.key, r.value.name, len(r.value.paths)) for r in out] == [("12", "a", 1)]


def test_profile_and_url(spark):
    df = spark.createDataFrame([('<div class="MAvaName"><i class="MGenderf"></i></div>'
                                 '<span class="MAvaPlace flt1" title="海口"></span>',
                                 "http://www.x.cn/u/40123456.html"),
                                ('<div class="MAvaName"><i class="MGender"></i></div>', "http://www.x.cn/u/1.html")],
                               "html string, url string")
    r = X.profile_fields(df).withColumn("id", X.user_id_from_url("url")).collect()
    assert [(x.custom_cty, x.custom_sex, x.id) for x in r] == [("海口", "f", "40123456"), (None, None, "1")]


def test_similarity_and_blocking_exact(spark):
    q = spark.createDataFrame([("桂林市",), ("abc",), ("xyz",)], "q string")
    ch = spark.createDataFrame([(1, 1, "桂林"), (2, 1, "南宁"), (3, 2, "abd")], "ord long, level int, name string")
    got = {(r.q, r.name): r.score for r in SJ.candidates(q, ch).collect()}
    assert got == {("桂林市", "桂林"): 67, ("abc", "abd"): 67}


def test_resolve_users(spark):
    gaz = spark.createDataFrame([(1, 1, "广西", "广西"), (2, 2, "桂林", "广西"), (3, 3, "阳朔", "广西"),
                                 (10, 1, "四川", "四川"), (11, 2, "成都", "四川"), (12, 3, "阳朔", "四川")],
                                "ord long, level int, name string, province string")
    users = spark.createDataFrame([("u1", "桂林", None), ("u2", "阳朔", None), ("u3", "火星", "旧省"),
                                   ("u4", None, "旧省"), ("u5", "- ,成都 市", None)],
                                  "custom_id string, custom_cty string, custom_province string")
    got = {r.custom_id: r.custom_province for r in FZ.resolve_users(users, gaz).collect()}
    assert got == {"u1": "广西", "u2": "广西", "u3": "旧省", "u4": "旧省", "u5": "四川"}


def test_resolve_unspaced_towns(spark):
    gaz = spark.createDataFrame([(1, 1, "广西", "广西"), (2, 2, "桂林", "广西"), (3, 3, "阳朔", "广西"),
                                 (10, 1, "四川", "四川"), (11, 2, "成都", "四川"), (12, 2, "成", "四川")],
                                "ord long, level int, name string, province string")
    towns = ["广西桂林市", "四川成都", "- 桂林阳朔县", "成都市区内", "桂林市", "海边的小镇", None, "-", ""]
    users = spark.createDataFrame([(str(i), t, None) for i, t in enumerate(towns)],
                                  "custom_id string, custom_cty string, custom_province string")
    got = {r.custom_id: (r.custom_province, r.match_name) for r in FZ.resolve_users(users, gaz).collect()}
    assert [got[str(i)][0] for i in range(9)] == ["广西", "四川", "广西", "四川", "广西", None, None, None, None]
    assert got["3"][1] == "成都"


def test_scorer_is_a_parameter(spark):
    from roamlens.functions.columns import partial_similarity
    q = spark.createDataFrame([("广西桂林",), ("xyz",)], "q string")
    ch = spark.createDataFrame([(1, 1, "桂林"), (2, 1, "南宁")], "ord long, level int, name string")
    got = {(r.q, r.name): r.score for r in SJ.candidates(q, ch, threshold=60, scorer=partial_similarity).collect()}
    assert got == {("广西桂林", "桂林"): 100}


def test_stop_words_keep_order_and_duplicates(spark):
    d = spark.createDataFrame([(1, ["a", "the", "b", "a", "7"])], "doc_id long, words array<string>")
    r = TX.remove_stop_words(d, "words", ["the"], numeric=True).first()
    assert r.words == ["a", "b", "a"]
    s = spark.createDataFrame([("the",), ("b",)], "word string")
    r2 = TX.remove_stop_words_table(d, "doc_id", "words", s).first()
    assert r2.words == ["a", "a", "7"]


def test_prefix_filter_is_exact(spark):
    """Thresholded candidates equal the unthresholded ones restricted to score > t."""
    import random
    rnd = random.Random(7)
    alpha = "aabbcdeé桂林 -"
    qs = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 9))) for _ in range(120)]
    cs = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 9))) for _ in range(80)]
    q = spark.createDataFrame([(x,) for x in qs], "q string")
    ch = spark.createDataFrame([(i, 1 + i % 3, x) for i, x in enumerate(cs)], "ord long, level int, name string")
    full = {(r.q, r.ord, r.score) for r in SJ.candidates(q, ch, threshold=0).collect() if r.score > 60}
    pref = {(r.q, r.ord, r.score) for r in SJ.candidates(q, ch, threshold=60).collect()}
    assert full and pref == full


def test_salted_top_k_equals_window(spark):
    from pyspark.sql import Window
    from roamlens.operators.ordering import top_k_per_group
    rows = [("hot", f"w{i}", i % 17) for i in range(2000)] + [("cold", f"v{i}", i) for i in range(7)]
    df = spark.createDataFrame(rows, "g string, word string, n int")
    order = [F.desc("n"), F.asc("word")]
    got = {(r.g, r.word, r.rank) for r in top_k_per_group(df, ["g"], order, 25, "word", salt_buckets=8).collect()}
    w = Window.partitionBy("g").orderBy(*order)
    want = {(r.g, r.word, r.rank) for r in df.withColumn("rank", F.row_number().over(w)).filter("rank <= 25").collect()}
    assert got == want


def test_running_totals(spark):
    from roamlens.operators.ordering import running_totals
    df = spark.createDataFrame([(i, i % 3) for i in range(500)], "s int, x int")
    got = {r.s: r.cum_x for r in running_totals(df, [F.desc("s")], ["x"], num_partitions=6).collect()}
    acc, want = 0, {}
    for s in range(499, -1, -1):
        acc += s % 3
        want[s] = acc
    assert got == want


def test_upsert_redoes_uncommitted_version(spark, tmp):
    import os
    a = spark.createDataFrame([("k", "v1", 1)], "key string, val string, ingest_seq int")
    b = spark.createDataFrame([("k", "v2", 2)], "key string, val string, ingest_seq int")
    UP.upsert_to_path(spark, a, tmp, ["key"], version=1)
    os.makedirs(os.path.join(tmp, "v=2", "_temporary"))          # a write that died half-way
    assert {r.val for r in UP.current_version(spark, tmp).collect()} == {"v1"}
    UP.upsert_to_path(spark, b, tmp, ["key"], version=2)          # replay redoes it
    assert {r.val for r in UP.current_version(spark, tmp).collect()} == {"v2"}


PAGE = ('<html><div class="title"><h1>两江四湖</h1></div>'
        '<div class="mod mod-detail"><dl><dt>交通</dt><dd>乘 <b>2</b> 路</dd><dd>步行</dd></dl>'
        '<dl><dt>门票</dt><dd><div>120元</div></dd></dl><dl><dt>开放时间</dt><dd>8:00-22:00</dd></dl></div>'
        '<div class="mod mod-location"><div><p>桂林市秀峰区</p></div></div>'
        '<div id="poi-navbar"><a>评论</a><span>评论 (37条)</span></div>'
        '<script>window.Env = {"mddid": 12810, "poiid": 5411};\n</script></html>')
PAGE_SHORT = ('<div class="title"><h1>象鼻山</h1></div><div class="mod mod-detail"><dl><dt>交通</dt><dd>公交</dd></dl>'
              '<dl><dt>门票</dt><dd><div>免费</div></dd></dl></div><div id="poi-navbar"><span>评论</span></div>')


def test_detail_fields(spark):
    df = spark.createDataFrame([("a", PAGE), ("b", PAGE_SHORT)], "poi_url string, html string")
    r = {x.poi_url: x for x in X.detail_fields(df).collect()}
    a, b = r["a"], r["b"]
    assert (a.scene_spot_name, a.traffic, a.price, a.open_time, a.position) == (
        "两江四湖", ["乘 2 路", "步行"], "120元", "8:00-22:00", "桂林市秀峰区")
    assert (a.comment_num_count, a.mddid, a.poi_id) == ("37", "12810", "5411")
    assert (b.scene_spot_name, b.traffic, b.price, b.open_time, b.position, b.comment_num_count, b.mddid) == (
        "象鼻山", ["公交"], "免费", None, None, None, None)


def test_detail_fields_with_attributes(spark):
    page = ('<div class="title big"><h1>no</h1></div><div class="title" id="t">\n<h1 class="n">石林</h1></div>'
            '<div class="mod mod-detail" data-x="1"><dl class="a"><dt>交通</dt><dd class="l">车<ul><li>1</li></ul></dd></dl>'
            '<dl><dt>门票</dt><dd>\n<div class="p">80元</div></dd></dl></div><div class="mod mod-x"><dl><dd>other</dd></dl></div>'
            '<div class="mod mod-location" id="l"><div class="i"><p class="s">昆明</p></div></div>')
    r = X.detail_fields(spark.createDataFrame([(page,), ("",), (None,)], "html string")).collect()
    assert (r[0].scene_spot_name, r[0].traffic, r[0].price, r[0].open_time, r[0].position) == ("石林", ["车1"], "80元", None, "昆明")
    assert [(x.scene_spot_name, x.price) for x in r[1:]] == [(None, None)] * 2


def test_comment_response(spark):
    import json
    block = ('<li class="rev-item comment-item clearfix" id="{0}"><ul><li>tag</li></ul><a class="name" href="/u/{0}.html">n</a>'
             '<span class="s-star s-star4"></span><p class="rev-txt" data-a="b">好 {0}</p><span class="time" x="y">2018-07-0{0}</span></li>')
    body = json.dumps({"data": {"html": "<ul>" + block.format(1) + block.format(2) + "</ul>",
                                "controller_data": {"poi_id": 54, "comment_count": 2}}})
    df = spark.createDataFrame([(body,), ("[]",), (None,), ("no json",)], "body string")
    r = X.comment_response_rows(df).orderBy("pos").collect()
    assert [(x.poi_id, x.comment_count, x.pos, x.comment_text, x.comment_time, x.comment_star, x.custom_id) for x in r] == [
        ("54", 2, 1, "好,1", "2018-07-01", "4", "1"), ("54", 2, 2, "好,2", "2018-07-02", "4", "2")]
    listing = json.dumps({"data": {"list": '<a href="/poi/7.html">a</a><a href="/poi/8.html">b</a>',
                                   "page": '<a class="pi pg-next" data-page="3" rel="next">'}})
    l = X.listing_response(spark.createDataFrame([(listing,)], "body string")).first()
    assert (l.links, l.next_page) == (["/poi/7.html", "/poi/8.html"], "3")


def test_null_group_keys_stay(spark):
    from roamlens.operators import sampling as SM
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "g string, o int")
    assert sorted((r.g or "", r.o, r.rn) for r in group_ordinal(df, ["g"], ["o"], num_partitions=3).collect()) == [
        ("", 3, 1), ("", 4, 2), ("a", 1, 1), ("a", 2, 2)]
    assert SM.first_n_per_class(df, "g", "o", 1).count() == 2
    assert R.bundle_per_group(df, "g", ["o"], ["o"]).count() == 4


def test_update_from_takes_the_last(spark):
    t = spark.createDataFrame([("k", "old"), ("j", "old")], "key string, v string")
    for rows in ([(1, "k", None), (2, "k", "new")], [(2, "k", "new"), (1, "k", "first"), (3, "k", None)]):
        u = spark.createDataFrame(rows, "n int, key string, v string")
        assert {r.key: r.v for r in R.update_from(t, u, "key", "v", "n").collect()} == {"k": "new", "j": "old"}


def test_partial_similarity(spark):
    from roamlens.functions.columns import partial_similarity
    r = spark.createDataFrame([("桂林市", "桂林"), ("abc", "xyz"), ("广西桂林", "桂林")], "a string, b string") \
        .select(partial_similarity("a", "b").alias("p"), similarity("a", "b").alias("s")).collect()
    assert [(x.p, x.s) for x in r] == [(100, 67), (0, 0), (100, 50)]
