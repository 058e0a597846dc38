"""Declared schemas: driver tables and the domain records.

Every read passes one of these; nothing is inferred at run time.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# ---------------------------------------------------------------- driver tables
TABLES: dict[str, T.StructType] = {
    "region": _st(("r_regionkey", I), ("r_name", S)),
    "nation": _st(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _st(("c_custkey", L), ("c_name", S), ("c_nationkey", I), ("c_acctbal", D),
                    ("c_mktsegment", S)),
    "supplier": _st(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", D)),
    "part": _st(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S), ("p_size", I),
                ("p_retailprice", D)),
    "orders": _st(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S), ("o_totalprice", D),
                  ("o_orderdate", TS), ("o_orderpriority", S)),
    "lineitem": _st(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L), ("l_linenumber", I),
                    ("l_quantity", D), ("l_extendedprice", D), ("l_discount", D), ("l_tax", D),
                    ("l_returnflag", S), ("l_linestatus", S), ("l_shipdate", TS)),
    "events": _st(("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S), ("value", D),
                  ("props", S)),
    "documents": _st(("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L)),
    "embeddings": _st(("vec_id", L), ("embedding", T.ArrayType(T.FloatType())), ("label", I)),
    "pages": _st(("page_id", L), ("url", S), ("html", S)),
    "benchmark": _st(("item_id", L), ("text", S)),
    "labels": _st(("doc_id", L), ("quality", I), ("toxic", I)),
    "conversations": _st(("conv_id", L), ("turn", L), ("role", S), ("text", S)),
}

# ---------------------------------------------------------------- domain records
LATLNG = T.StructType([T.StructField("lat", D), T.StructField("lng", D)])

POI = _st(("poi_id", S), ("mddid", S), ("scene_spot_name", S), ("price", S),
          ("traffic", T.ArrayType(S)), ("open_time", S), ("position", S),
          ("comment_num_count", S), ("lat", D), ("lng", D), ("ingest_seq", L))

COMMENT = _st(("poi_id", S), ("custom_id", S), ("comment_text", S), ("comment_time", S),
              ("comment_star", S), ("ingest_seq", L))

USER_PROFILE = _st(("custom_id", S), ("custom_cty", S), ("custom_sex", S))

USER_CURATED = _st(("custom_id", S), ("custom_cty", S), ("custom_sex", S), ("custom_province", S))

HOTEL_AREA = _st(("mddid", S), ("name", S), ("price", S), ("lat", D), ("lng", D),
                 ("paths", T.ArrayType(LATLNG)))

SCENE_AREA = _st(("area_id", S), ("area_paths", T.ArrayType(LATLNG)))

RAW_RESPONSE = _st(("kind", S), ("url", S), ("body", S))

RAW_PAGE = _st(("poi_url", S), ("html", S))

GAZETTEER = _st(("ord", L), ("level", I), ("name", S), ("province", S))

SEED_PROVINCE = _st(("mddid", S), ("province", S))

LEXICON = _st(("word", S), ("kind", S), ("weight", D))

LABELLED_TOKENS = _st(("doc_id", L), ("label", I), ("words", T.ArrayType(S)))

SCORED = _st(("doc_id", L), ("label", I), ("prediction", I), ("score", D))

COMMENT_EVENT = _st(("event_id", S), ("poi_id", S), ("custom_id", S), ("comment_text", S),
                    ("comment_time", TS), ("comment_star", I))

# Gazetteer JSON in the two shapes found in the wild:
#   list form  [{province: [{city: [county, ...]}, ...]}, ...]
#   map form   {province: {city: [county, ...]}}
GAZETTEER_JSON_LIST = T.ArrayType(T.MapType(S, T.ArrayType(T.MapType(S, T.ArrayType(S)))))
GAZETTEER_JSON_MAPS = T.ArrayType(T.MapType(S, T.MapType(S, T.ArrayType(S))))
GAZETTEER_JSON_MAP = T.MapType(S, T.MapType(S, T.ArrayType(S)))
