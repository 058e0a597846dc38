"""Semi-structured extraction: raw pages / JSON responses in, typed rows out
(SURVEY §2.2).  Regex and JSON built-ins only; patterns avoid look-around so
they behave the same in Java regex and RE2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamlens.functions.columns import col_, first_digits, whitespace_to_commas

# Markup patterns of the crawled site (listing, detail and
# comment fragments, user profile).
LINK_PATTERN = r'<a href="([^"]*)"'
LISTING_LINK_PATTERN = r'<a href="(.*?)html'
NEXT_PAGE_PATTERN = r'<a class="pi pg-next" data-page="(.*?)" rel'
ENV_PATTERN = r'window\.Env = (\{.*?\});'
COMMENT_BLOCK_OPEN = r'<li class="rev-item comment-item clearfix"[^>]*>'
COMMENT_TEXT_PATTERN = r'(?s)rev-txt"[^>]*>(.*?)</p>'
COMMENT_TIME_PATTERN = r'class="time"[^>]*>(.*?)<'
COMMENT_STAR_PATTERN = r's-star[^>]*?(\d)'
COMMENT_USER_PATTERN = r'class="name" href="([^"]*)"'
PROFILE_CITY_PATTERN = r'class="MAvaPlace flt1" title="([^"]*)"'
PROFILE_SEX_PATTERN = r'<div class="MAvaName"><i class="([^"]*)"'
COMMENTS_PER_PAGE = 15
# The four province seeds of the crawl (mddid, province).
SEED_PROVINCES = [("12810", "Guangxi"), ("14103", "Guizhou"), ("12711", "Yunnan"), ("12703", "Sichuan")]


def origin(url) -> Column:
    """scheme://host of a URL."""
    return F.regexp_extract(col_(url), r"^([a-z]+://[^/?#]+)", 1)


def links(df: DataFrame, html: str = "html", base_url: str | Column = "url",
          pattern: str = LINK_PATTERN, suffix: str = "") -> DataFrame:
    """Every link of a page as one row (pos is 1-based), made absolute
    with the page origin; ``suffix`` re-appends what the pattern consumed."""
    return (df.select("*", F.posexplode(F.regexp_extract_all(F.col(html), F.lit(pattern), 1))
                      .alias("__pos", "href"))
            .withColumn("pos", (F.col("__pos") + 1).cast("int"))
            .withColumn("link_url", F.concat(origin(base_url), F.col("href"), F.lit(suffix)))
            .drop("__pos"))


def next_page(html) -> Column:
    """Next-page token or null (end of listing)."""
    return F.nullif(F.regexp_extract(col_(html), NEXT_PAGE_PATTERN, 1), F.lit(""))


def fan_out_pages(df: DataFrame, count_col: str, per_page: int = COMMENTS_PER_PAGE,
                  out: str = "page") -> DataFrame:
    """Pages 1..ceil(n / per_page); no rows when n is null, blank or 0 (Q11)."""
    n = F.col(count_col).try_cast("long")
    pages = F.when(n > 0, F.sequence(F.lit(1).cast("long"), F.ceil(n / per_page).cast("long")))
    return df.withColumn(out, F.explode(pages))


def tag_text(html, tag: str) -> Column:
    """Inner text of the first ``<tag>`` element, '' when absent."""
    return F.regexp_extract(col_(html), f"(?s)<{tag}>(.*?)</{tag}>", 1)


def nth_match(html, pattern: str, i: int) -> Column:
    """X4 ordinal access (``dl[i]``): i-th match (1-based) or null."""
    return F.try_element_at(F.regexp_extract_all(col_(html), F.lit(pattern), 1), F.lit(i))


def env_field(html, field: str) -> Column:
    """A field of the ``window.Env = {...};`` JSON embedded in a script."""
    return F.get_json_object(F.regexp_extract(col_(html), ENV_PATTERN, 1), f"$.{field}")


def json_map_rows(df: DataFrame, body: str, value_type: str, skip_key: str | None = "0") -> DataFrame:
    """A JSON object of id -> record as one row per entry; an empty
    payload (``[]`` or ``{}``) gives no rows; ``skip_key`` is dropped."""
    m = F.from_json(F.col(body), f"map<string,{value_type}>")
    out = df.select("*", F.explode(m).alias("key", "value"))
    if skip_key is not None:
        out = out.filter(F.col("key") != skip_key)
    return out


def strip_tags(c) -> Column:
    return F.regexp_replace(col_(c), r"<[^>]*>", "")


def comment_blocks(df: DataFrame, html: str = "html") -> DataFrame:
    """X8–X10 + X6: one row per ``li.rev-item.comment-item`` block with text
    (tags stripped, every whitespace char -> ','), time, star digit and the
    commenter id from the profile link.  A block runs from its opening tag to the
    next one, so lists inside it are part of it."""
    blocks = df.select("*", F.posexplode(F.split(F.col(html), COMMENT_BLOCK_OPEN)).alias("pos", "__blk")).filter("pos > 0")
    b = F.col("__blk")
    return (blocks
            .withColumn("comment_text", whitespace_to_commas(strip_tags(F.regexp_extract(b, COMMENT_TEXT_PATTERN, 1))))
            .withColumn("comment_time", F.regexp_extract(b, COMMENT_TIME_PATTERN, 1))
            .withColumn("comment_star", F.nullif(F.regexp_extract(b, COMMENT_STAR_PATTERN, 1), F.lit("")))
            .withColumn("custom_id", first_digits(F.regexp_extract(b, COMMENT_USER_PATTERN, 1)))
            .drop("__blk"))


# Fixed value: the fields of a comment response that are read.
COMMENT_RESPONSE = ("data struct<html:string,controller_data:struct<poi_id:string,comment_count:string>>")
LISTING_RESPONSE = "data struct<list:string,page:string>"


def comment_response_rows(df: DataFrame, body: str = "body") -> DataFrame:
    """S15 + X8: comment blocks of a JSON response, each with the response's
    ``poi_id`` and ``comment_count``; a body that is no such JSON gives no rows."""
    d = df.withColumn("__r", F.from_json(body, COMMENT_RESPONSE))
    d = (d.withColumn("__html", F.col("__r.data.html"))
          .withColumn("poi_id", F.col("__r.data.controller_data.poi_id"))
          .withColumn("comment_count", F.col("__r.data.controller_data.comment_count").cast("int")))
    return comment_blocks(d.drop("__r"), "__html").drop("__html")


def listing_response(df: DataFrame, body: str = "body") -> DataFrame:
    """S15 + X1 + X2: the detail links (array, without site) and the next-page token
    of a listing response."""
    d = df.withColumn("__r", F.from_json(body, LISTING_RESPONSE))
    links_ = F.transform(F.regexp_extract_all(F.col("__r.data.list"), F.lit(LISTING_LINK_PATTERN), 1),
                         lambda x: F.concat(x, F.lit("html")))
    return d.withColumn("links", links_).withColumn("next_page", next_page(F.col("__r.data.page"))).drop("__r")


def user_id_from_url(url) -> Column:
    """X11: path segment 4 of the profile URL without ``.html``."""
    return F.replace(F.split_part(col_(url), F.lit("/"), F.lit(5)), F.lit(".html"), F.lit(""))


def profile_fields(df: DataFrame, html: str = "html") -> DataFrame:
    """Home town from the place ``title`` attribute, sex from the gender
    icon class without ``MGender``; missing -> null (Q14)."""
    h = F.col(html)
    return (df.withColumn("custom_cty", F.nullif(F.regexp_extract(h, PROFILE_CITY_PATTERN, 1), F.lit("")))
              .withColumn("custom_sex", F.nullif(F.replace(F.regexp_extract(h, PROFILE_SEX_PATTERN, 1),
                                                           F.lit("MGender"), F.lit("")), F.lit(""))))


def coords_join(poi: DataFrame, responses: DataFrame, key: str = "poi_id", body: str = "body") -> DataFrame:
    """Attach ``data.controller_data.poi.{lat,lng}`` of the position
    response to its POI (left join: POIs without a response keep nulls)."""
    pos = responses.select(
        key,
        F.get_json_object(body, "$.data.controller_data.poi.lat").cast("double").alias("lat"),
        F.get_json_object(body, "$.data.controller_data.poi.lng").cast("double").alias("lng"))
    return poi.join(pos, key, "left")


def seed_provinces(spark) -> DataFrame:
    """The seed dimension (a four-row broadcast side)."""
    return spark.createDataFrame(
        [(i, m, p) for i, (m, p) in enumerate(SEED_PROVINCES)], "seed_ord int, mddid string, province string")


def route(df: DataFrame, type_col: str, value: str) -> DataFrame:
    """The records of one type, for its own sink."""
    return df.filter(F.col(type_col) == value)


# Detail-page fragments (title block, detail list entries,
# location block, navigation bar with the comment count).
DETAIL_NAME_PATTERN = r'(?s)<div class="title"[^>]*>\s*<h1[^>]*>(.*?)</h1>'
# the detail block runs to the next module or the end of the page
DETAIL_DL_PATTERN = r'(?s)<div class="mod mod-detail"[^>]*>(.*?)(?:<div class="mod |\z)'
DL_PATTERN = r"(?s)<dl\b[^>]*>(.*?)</dl>"
DD_PATTERN = r"(?s)<dd\b[^>]*>(.*?)</dd>"
DD_DIV_PATTERN = r"(?s)<dd\b[^>]*>\s*<div\b[^>]*>(.*?)</div>"
LOCATION_PATTERN = r'(?s)<div class="mod mod-location"[^>]*>\s*<div[^>]*>\s*<p[^>]*>(.*?)</p>'
NAVBAR_COUNT_PATTERN = r'(?s)<div id="poi-navbar"[^>]*>.*?<span[^>]*>(.*?)</span>'


def detail_fields(df: DataFrame, html: str = "html") -> DataFrame:
    """X4 + X5 + X6: the fields of a POI detail page.  ``dl[1]`` gives the
    traffic lines (array; empty when missing), ``dl[2]`` the price, ``dl[3]``
    the opening time; each field falls back to its own default when absent
    (null here, Q14); the comment count is the first digit run of the navbar
    span; mddid / poiid come from the embedded ``window.Env`` JSON."""
    h = F.col(html)
    dls = F.regexp_extract_all(F.regexp_extract(h, DETAIL_DL_PATTERN, 1), F.lit(DL_PATTERN), 1)
    dl = lambda i: F.try_element_at(dls, F.lit(i))
    traffic = F.coalesce(F.transform(F.regexp_extract_all(dl(1), F.lit(DD_PATTERN), 1), lambda x: F.trim(strip_tags(x))),
                         F.array().cast("array<string>"))
    txt = lambda c: F.nullif(F.trim(strip_tags(c)), F.lit(""))
    return (df.withColumn("scene_spot_name", txt(F.regexp_extract(h, DETAIL_NAME_PATTERN, 1)))
              .withColumn("traffic", traffic)
              .withColumn("price", txt(F.regexp_extract(F.coalesce(dl(2), F.lit("")), DD_DIV_PATTERN, 1)))
              .withColumn("open_time", txt(F.regexp_extract(F.coalesce(dl(3), F.lit("")), DD_PATTERN, 1)))
              .withColumn("position", txt(F.regexp_extract(h, LOCATION_PATTERN, 1)))
              .withColumn("comment_num_count", first_digits(F.regexp_extract(h, NAVBAR_COUNT_PATTERN, 1)))
              .withColumn("mddid", env_field(html, "mddid"))
              .withColumn("poi_id", env_field(html, "poiid")))
