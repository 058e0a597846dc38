"""Extraction queries over pages, events and markup derived from the driver
tables (SURVEY §2.2, §2.14).  Where the crawled markup shape is needed, it is
built from table rows with concat (same construction in the oracle)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roamlens.functions.columns import first_digits, whitespace_to_commas, ts_text
from roamlens.operators import extract as X
from roamlens.plans.registry import register
from roamlens.plans.standins import Tables

NBSP = " "
IDEO_SPACE = "　"


@register("page_links", ids="X1 X14", sql=r"""
WITH t AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)
SELECT page_id, unnest(l) AS href, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS pos,
       regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || unnest(l) AS link_url
FROM t""")
def page_links(spark, sf_dir):
    p = Tables(spark, sf_dir)["pages"].select("page_id", "url", "html")
    return X.links(p).select("page_id", "href", "pos", "link_url")


@register("page_fields", ids="X4", sql=r"""
SELECT page_id,
       regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
       regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1,
       regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
       regexp_extract_all(html, '<li>(.*?)</li>', 1)[3] AS third_item
FROM pages""")
def page_fields(spark, sf_dir):
    p = Tables(spark, sf_dir)["pages"]
    return p.select("page_id", X.tag_text("html", "title").alias("title"),
                    X.tag_text("html", "h1").alias("h1"),
                    F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("lang"),
                    X.nth_match("html", r"<li>(.*?)</li>", 3).alias("third_item"))


@register("page_digits", ids="X6", sql=r"""
SELECT page_id, NULLIF(regexp_extract(url, '(\d+)', 1), '') AS url_digits,
       NULLIF(regexp_extract(html, 'track\((\d+)\)', 1), '') AS track_id
FROM pages""")
def page_digits(spark, sf_dir):
    p = Tables(spark, sf_dir)["pages"]
    return p.select("page_id", first_digits("url").alias("url_digits"),
                    F.nullif(F.regexp_extract("html", r"track\((\d+)\)", 1), F.lit("")).alias("track_id"))


# listing fragment: the page html plus a next-page anchor when the URL carries ?page=N
def _listing(p):
    n = F.regexp_extract("url", r"page=(\d+)", 1)
    anchor = F.when(n != "", F.concat(F.lit('<a class="pi pg-next" data-page="'),
                                      (n.cast("int") + 1).cast("string"), F.lit('" rel="next">')))
    return p.select("page_id", F.concat_ws("", F.col("html"), anchor).alias("listing"))


@register("page_next_token", ids="X2", sql=r"""
WITH l AS (SELECT page_id, html || COALESCE(CASE WHEN regexp_extract(url, 'page=(\d+)', 1) <> ''
             THEN '<a class="pi pg-next" data-page="' || CAST(CAST(regexp_extract(url, 'page=(\d+)', 1) AS INTEGER) + 1 AS VARCHAR) || '" rel="next">' END, '') AS listing
           FROM pages)
SELECT page_id, NULLIF(regexp_extract(listing, '<a class="pi pg-next" data-page="(.*?)" rel', 1), '') AS next_page
FROM l""")
def page_next_token(spark, sf_dir):
    l = _listing(Tables(spark, sf_dir)["pages"])
    return l.select("page_id", X.next_page("listing").alias("next_page"))


COMMENT_URL = "http://pagelet.example.cn/poi/pagelet/poiCommentListApi?params="


@register("page_fanout", ids="X3 X14", sql=f"""
WITH c AS (SELECT p.p_partkey AS poi_id, count(l.l_partkey) AS n
           FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey GROUP BY 1)
SELECT poi_id, n, CAST(page AS BIGINT) AS page,
       '{COMMENT_URL}' || '{{"poi_id":"' || CAST(poi_id AS VARCHAR) || '","page":' || CAST(page AS VARCHAR) || ',"just_comment":1}}' AS request_url
FROM (SELECT poi_id, n, unnest(generate_series(1, CAST(ceil(n / 15.0) AS BIGINT))) AS page FROM c WHERE n > 0)""")
def page_fanout(spark, sf_dir):
    t = Tables(spark, sf_dir)
    counts = t["lineitem"].groupBy(F.col("l_partkey").alias("poi_id")).agg(F.count(F.lit(1)).alias("n"))
    c = t.poi.select("poi_id").join(counts, "poi_id", "left")
    f = X.fan_out_pages(c, "n")
    return f.select("poi_id", "n", "page",
                    F.format_string(COMMENT_URL + '{"poi_id":"%s","page":%d,"just_comment":1}',
                                    F.col("poi_id").cast("string"), F.col("page")).alias("request_url"))


@register("event_json_path", ids="X5", sql="""
SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def event_json_path(spark, sf_dir):
    e = Tables(spark, sf_dir)["events"]
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@register("env_script_fields", ids="X5", sql=r"""
WITH d AS (SELECT page_id, html || '<script>window.Env = {"poiid":' || CAST(page_id AS VARCHAR) ||
                  ',"mddid":' || CAST(length(url) AS VARCHAR) || '};</script>' AS html FROM pages)
SELECT page_id, json_extract_string(regexp_extract(html, 'window\.Env = (\{.*?\});', 1), '$.poiid') AS poiid,
       json_extract_string(regexp_extract(html, 'window\.Env = (\{.*?\});', 1), '$.mddid') AS mddid
FROM d""")
def env_script_fields(spark, sf_dir):
    p = Tables(spark, sf_dir)["pages"]
    d = p.select("page_id", F.concat(F.col("html"), F.lit('<script>window.Env = {"poiid":'),
                                     F.col("page_id").cast("string"), F.lit(',"mddid":'),
                                     F.length("url").cast("string"), F.lit("};</script>")).alias("html"))
    return d.select("page_id", X.env_field("html", "poiid").alias("poiid"),
                    X.env_field("html", "mddid").alias("mddid"))


@register("json_map_explode", ids="X7", sql="""
SELECT event_id, k AS key, CAST(json_extract_string(props, '$."' || k || '"') AS INTEGER) AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) WHERE k <> '0'""")
def json_map_explode(spark, sf_dir):
    e = Tables(spark, sf_dir)["events"].select("event_id", "props")
    return X.json_map_rows(e, "props", "int").select("event_id", "key", "value")


@register("whitespace_commas", ids="X9", sql=r"""
SELECT doc_id, regexp_replace(text, '[\s\p{Z}]', ',', 'g') AS text_commas FROM documents
UNION ALL
SELECT -1 - (conv_id * 1000 + turn) AS doc_id, regexp_replace(text, '[\s\p{Z}]', ',', 'g') FROM conversations""")
def whitespace_commas(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = t["documents"].select("doc_id", whitespace_to_commas("text").alias("text_commas"))
    c = t["conversations"].select((F.lit(-1) - (F.col("conv_id") * 1000 + F.col("turn"))).alias("doc_id"),
                                  whitespace_to_commas("text").alias("text_commas"))
    return d.unionByName(c)


# Comment fragments: one <li> block per lineitem, grouped per order (<= 7 lines).
def _comment_html(t):
    li, o, p = t["lineitem"], t["orders"], t["part"]
    blk = F.concat(
        F.lit('<li class="rev-item comment-item clearfix" data-id="1"><ul><li>badge</li></ul><a class="name" href="/u/'),
        F.col("o_custkey").cast("string"), F.lit('.html">u</a><span class="s-star s-star'),
        F.col("l_linenumber").cast("string"), F.lit('"></span><p class="rev-txt">'),
        F.col("p_name"), F.lit(NBSP), F.col("l_returnflag"), F.lit(" <b>"), F.col("l_linestatus"),
        F.lit("</b>" + IDEO_SPACE + "ok</p><span class=\"time\">"), ts_text("l_shipdate"),
        F.lit("</span></li>"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return (j.groupBy("l_orderkey")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", blk.alias("b")))),
                                          lambda s: s["b"]), "").alias("html")))


SQL_COMMENT_HTML = r"""
WITH j AS (SELECT l.l_orderkey, l.l_linenumber,
   '<li class="rev-item comment-item clearfix" data-id="1"><ul><li>badge</li></ul><a class="name" href="/u/' || CAST(o.o_custkey AS VARCHAR) ||
   '.html">u</a><span class="s-star s-star' || CAST(l.l_linenumber AS VARCHAR) || '"></span><p class="rev-txt">' ||
   p.p_name || chr(160) || l.l_returnflag || ' <b>' || l.l_linestatus || '</b>' || chr(12288) || 'ok</p><span class="time">' ||
   strftime(l.l_shipdate, '%Y-%m-%d %H:%M:%S') || '</span></li>' AS b
   FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey),
h AS (SELECT l_orderkey, string_agg(b, '' ORDER BY l_linenumber, b) AS html FROM j GROUP BY 1),
s AS (SELECT l_orderkey, html, regexp_split_to_array(html, '<li class="rev-item comment-item clearfix"[^>]*>')[2:] AS parts FROM h),
x AS (SELECT l_orderkey, unnest(parts) AS blk, unnest(range(1, len(parts) + 1)) AS pos FROM s)"""


@register("comment_blocks", ids="X8 X9 X10 X6", sql=SQL_COMMENT_HTML + r"""
SELECT l_orderkey AS order_key, CAST(pos AS INTEGER) AS pos,
       regexp_replace(regexp_replace(regexp_extract(blk, '(?s)rev-txt"[^>]*>(.*?)</p>', 1), '<[^>]*>', '', 'g'), '[\s\p{Z}]', ',', 'g') AS comment_text,
       regexp_extract(blk, 'class="time"[^>]*>(.*?)<', 1) AS comment_time,
       NULLIF(regexp_extract(blk, 's-star[^>]*?(\d)', 1), '') AS comment_star,
       NULLIF(regexp_extract(regexp_extract(blk, 'class="name" href="([^"]*)"', 1), '(\d+)', 1), '') AS custom_id
FROM x""")
def comment_blocks(spark, sf_dir):
    h = _comment_html(Tables(spark, sf_dir))
    return X.comment_blocks(h).select(F.col("l_orderkey").alias("order_key"), "pos", "comment_text",
                                      "comment_time", "comment_star", "custom_id")


@register("comment_response_rows", ids="S15 X8 X9 X10 X6", sql=SQL_COMMENT_HTML.replace(
    "h AS (SELECT l_orderkey, string_agg", "h0 AS (SELECT l_orderkey, count(*) AS cnt, string_agg").replace(
    "s AS (SELECT", """b AS (SELECT l_orderkey, to_json({'data': {'html': html, 'controller_data':
        {'poi_id': CAST(l_orderkey AS VARCHAR), 'comment_count': cnt}}}) AS body FROM h0),
h AS (SELECT l_orderkey, json_extract_string(body, '$.data.html') AS html,
        json_extract_string(body, '$.data.controller_data.poi_id') AS poi_id,
        CAST(json_extract_string(body, '$.data.controller_data.comment_count') AS INTEGER) AS comment_count FROM b),
s AS (SELECT poi_id, comment_count,""", 1).replace("x AS (SELECT", "x AS (SELECT poi_id, comment_count,") + r"""
SELECT poi_id, comment_count, CAST(pos AS INTEGER) AS pos,
       regexp_replace(regexp_replace(regexp_extract(blk, '(?s)rev-txt"[^>]*>(.*?)</p>', 1), '<[^>]*>', '', 'g'), '[\s\p{Z}]', ',', 'g') AS comment_text,
       regexp_extract(blk, 'class="time"[^>]*>(.*?)<', 1) AS comment_time
FROM x""")
def comment_response_rows(spark, sf_dir):
    """The comment pages of the crawl as JSON bodies (one per order)."""
    h = _comment_html(Tables(spark, sf_dir))
    n = F.size(F.split("html", X.COMMENT_BLOCK_OPEN)) - 1
    body = F.to_json(F.struct(F.struct(F.col("html"), F.struct(
        F.col("l_orderkey").cast("string").alias("poi_id"), n.alias("comment_count")).alias("controller_data")).alias("data")))
    return X.comment_response_rows(h.select(body.alias("body"))).select(
        "poi_id", "comment_count", "pos", "comment_text", "comment_time")


@register("listing_response", ids="S15 X1 X2", sql=r"""
WITH b AS (SELECT page_id, to_json({'data': {'list': regexp_replace(html, '(<a href="[^"]*)"', '\1.html"', 'g'),
             'page': '<a class="pi pg-next" data-page="' || CAST(page_id + 1 AS VARCHAR) || '" rel="next">'}}) AS body FROM pages),
p AS (SELECT page_id, regexp_extract_all(json_extract_string(body, '$.data.list'), '<a href="(.*?)html', 1) AS l,
             json_extract_string(body, '$.data.page') AS page FROM b)
SELECT page_id, CAST(len(l) AS INTEGER) AS n_links, l[1] || 'html' AS first_link,
       NULLIF(regexp_extract(page, '<a class="pi pg-next" data-page="(.*?)" rel', 1), '') AS next_page FROM p""")
def listing_response(spark, sf_dir):
    p = Tables(spark, sf_dir)["pages"]
    body = F.to_json(F.struct(F.struct(
        F.regexp_replace("html", r'(<a href="[^"]*)"', '$1.html"').alias("list"),
        F.concat(F.lit('<a class="pi pg-next" data-page="'), (F.col("page_id") + 1).cast("string"),
                 F.lit('" rel="next">')).alias("page")).alias("data")))
    d = X.listing_response(p.select("page_id", body.alias("body")))
    return d.select("page_id", F.size("links").alias("n_links"), F.try_element_at("links", F.lit(1)).alias("first_link"), "next_page")


def _profile_html(c, n):
    place = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit('<span class="MAvaPlace flt1" title="'),
                                                     F.col("n_name"), F.lit('"></span>')))
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .select(F.col("c_custkey").alias("custom_id"),
                    F.concat(F.lit("http://www.example.cn/u/"), F.col("c_custkey").cast("string"),
                             F.lit(".html")).alias("url"),
                    F.concat_ws("", F.lit('<div class="MAvaName"><i class="MGender'), F.col("c_mktsegment"),
                                F.lit('"></i></div>'), place).alias("html")))


SQL_PROFILE = """
WITH h AS (SELECT c.c_custkey AS custom_id,
     'http://www.example.cn/u/' || CAST(c.c_custkey AS VARCHAR) || '.html' AS url,
     '<div class="MAvaName"><i class="MGender' || c.c_mktsegment || '"></i></div>' ||
     COALESCE(CASE WHEN c.c_acctbal >= 0 THEN '<span class="MAvaPlace flt1" title="' || n.n_name || '"></span>' END, '') AS html
   FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)"""


@register("profile_fields", ids="X12", sql=SQL_PROFILE + """
SELECT custom_id, NULLIF(regexp_extract(html, 'class="MAvaPlace flt1" title="([^"]*)"', 1), '') AS custom_cty,
       NULLIF(replace(regexp_extract(html, '<div class="MAvaName"><i class="([^"]*)"', 1), 'MGender', ''), '') AS custom_sex
FROM h""")
def profile_fields(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return X.profile_fields(_profile_html(t["customer"], t["nation"])).select("custom_id", "custom_cty", "custom_sex")


@register("url_user_id", ids="X11 X14", sql=SQL_PROFILE + """
SELECT custom_id, url, replace(split_part(url, '/', 5), '.html', '') AS parsed_id FROM h""")
def url_user_id(spark, sf_dir):
    t = Tables(spark, sf_dir)
    h = _profile_html(t["customer"], t["nation"])
    return h.select("custom_id", "url", X.user_id_from_url("url").alias("parsed_id"))


@register("coords_join", ids="X13", sql="""
WITH r AS (SELECT p_partkey AS poi_id,
             '{"data":{"controller_data":{"poi":{"lat":' || CAST(p_size AS VARCHAR) || '.5,"lng":' ||
             CAST(p_partkey % 180 AS VARCHAR) || '.25}}}}' AS body
           FROM part WHERE p_size > 10)
SELECT p.p_partkey AS poi_id, p.p_name AS scene_spot_name,
       CAST(json_extract_string(r.body, '$.data.controller_data.poi.lat') AS DOUBLE) AS lat,
       CAST(json_extract_string(r.body, '$.data.controller_data.poi.lng') AS DOUBLE) AS lng
FROM part p LEFT JOIN r ON r.poi_id = p.p_partkey""")
def coords_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    part = t["part"]
    resp = part.filter(F.col("p_size") > 10).select(
        F.col("p_partkey").alias("poi_id"),
        F.concat(F.lit('{"data":{"controller_data":{"poi":{"lat":'), F.col("p_size").cast("string"),
                 F.lit('.5,"lng":'), (F.col("p_partkey") % 180).cast("string"), F.lit(".25}}}}")).alias("body"))
    return X.coords_join(t.poi, resp)


@register("seed_join", ids="X16", sql="""
WITH s(seed_ord, mddid, province) AS (VALUES (0, '12810', 'Guangxi'), (1, '14103', 'Guizhou'),
                                          (2, '12711', 'Yunnan'), (3, '12703', 'Sichuan'))
SELECT c.c_custkey AS custom_id, s.mddid, s.province
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN s ON s.seed_ord = n.n_regionkey""")
def seed_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c, n = t["customer"], t["nation"]
    seeds = F.broadcast(X.seed_provinces(spark))
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .join(seeds, F.col("n_regionkey") == F.col("seed_ord"))
            .select(F.col("c_custkey").alias("custom_id"), "mddid", "province"))


@register("append_route", ids="X17 S17", sql="""
SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'click'""")
def append_route(spark, sf_dir):
    e = Tables(spark, sf_dir)["events"]
    return X.route(e, "event_type", "click").select("event_id", "user_id", "ts", "value")


def _detail_pages(t):
    p = t["part"]
    counts = t["lineitem"].groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("cnt"))
    j = p.join(counts, "p_partkey", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    s = lambda c: F.col(c).cast("string")
    open_dl = F.when(F.col("p_size") > 20, F.concat(F.lit("<dl><dt>o</dt><dd>"), s("p_size"), F.lit(":00</dd></dl>"))) \
               .otherwise(F.lit(""))
    html = F.concat(F.lit('<div class="title"><h1>'), F.col("p_name"),
                    F.lit('</h1></div><div class="mod mod-detail"><dl class="d"><dt>t</dt><dd class="x">'), F.col("p_type"),
                    F.lit("</dd><dd> "), F.col("p_brand"), F.lit(" </dd></dl><dl><dt>p</dt><dd><div>"), s("p_size"),
                    F.lit("元</div></dd></dl>"), open_dl,
                    F.lit('</div><div class="mod mod-location" id="loc"><div class="in"><p>'), F.col("p_brand"),
                    F.lit('</p></div></div><div id="poi-navbar"><span>评论 ('), s("cnt"),
                    F.lit('条)</span></div><script>window.Env = {"mddid": '), s("p_size"), F.lit(', "poiid": '),
                    s("p_partkey"), F.lit("};\n</script>"))
    return j.select(F.col("p_partkey").alias("page_key"), html.alias("html"))


@register("detail_fields", ids="X4 X5 X6", sql=r"""
WITH c AS (SELECT l_partkey, count(*) AS cnt FROM lineitem GROUP BY 1),
d AS (SELECT p.p_partkey AS page_key,
        '<div class="title"><h1>' || p.p_name || '</h1></div><div class="mod mod-detail"><dl class="d"><dt>t</dt><dd class="x">' || p.p_type ||
        '</dd><dd> ' || p.p_brand || ' </dd></dl><dl><dt>p</dt><dd><div>' || CAST(p.p_size AS VARCHAR) || '元</div></dd></dl>' ||
        CASE WHEN p.p_size > 20 THEN '<dl><dt>o</dt><dd>' || CAST(p.p_size AS VARCHAR) || ':00</dd></dl>' ELSE '' END ||
        '</div><div class="mod mod-location" id="loc"><div class="in"><p>' || p.p_brand ||
        '</p></div></div><div id="poi-navbar"><span>评论 (' || CAST(coalesce(c.cnt, 0) AS VARCHAR) ||
        '条)</span></div><script>window.Env = {"mddid": ' || CAST(p.p_size AS VARCHAR) || ', "poiid": ' ||
        CAST(p.p_partkey AS VARCHAR) || '};' || chr(10) || '</script>' AS html
      FROM part p LEFT JOIN c ON c.l_partkey = p.p_partkey),
x AS (SELECT page_key, html,
        regexp_extract_all(regexp_extract(html, '(?s)<div class="mod mod-detail"[^>]*>(.*?)(?:<div class="mod |\z)', 1),
                           '(?s)<dl\b[^>]*>(.*?)</dl>', 1) AS dls FROM d)
SELECT page_key,
  NULLIF(trim(regexp_replace(regexp_extract(html, '(?s)<div class="title"[^>]*>\s*<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')), '') AS scene_spot_name,
  array_to_string(coalesce(list_transform(regexp_extract_all(dls[1], '(?s)<dd\b[^>]*>(.*?)</dd>', 1), lambda v: trim(regexp_replace(v, '<[^>]*>', '', 'g'))), []::VARCHAR[]), '|') AS traffic,
  NULLIF(trim(regexp_replace(regexp_extract(coalesce(dls[2], ''), '(?s)<dd\b[^>]*>\s*<div\b[^>]*>(.*?)</div>', 1), '<[^>]*>', '', 'g')), '') AS price,
  NULLIF(trim(regexp_replace(regexp_extract(coalesce(dls[3], ''), '(?s)<dd\b[^>]*>(.*?)</dd>', 1), '<[^>]*>', '', 'g')), '') AS open_time,
  NULLIF(trim(regexp_replace(regexp_extract(html, '(?s)<div class="mod mod-location"[^>]*>\s*<div[^>]*>\s*<p[^>]*>(.*?)</p>', 1), '<[^>]*>', '', 'g')), '') AS position,
  NULLIF(regexp_extract(regexp_extract(html, '(?s)<div id="poi-navbar"[^>]*>.*?<span[^>]*>(.*?)</span>', 1), '(\d+)', 1), '') AS comment_num_count,
  json_extract_string(regexp_extract(html, 'window\.Env = (\{.*?\});', 1), '$.mddid') AS mddid,
  json_extract_string(regexp_extract(html, 'window\.Env = (\{.*?\});', 1), '$.poiid') AS poi_id
FROM x""")
def detail_fields(spark, sf_dir):
    d = _detail_pages(Tables(spark, sf_dir))
    # the traffic list is rendered as one '|'-joined string for the value check
    return X.detail_fields(d).select("page_key", "scene_spot_name", F.array_join("traffic", "|").alias("traffic"),
                                     "price", "open_time", "position", "comment_num_count", "mddid", "poi_id")
