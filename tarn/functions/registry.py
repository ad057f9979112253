"""SQL functions of the engine, as SQL-bodied functions that Catalyst inlines.

A null argument gives null unless a function's note says otherwise. JSON
arrays are strings; an element is stringified as true/false, a number without
trailing zeros, a string as it is, and anything else as compact JSON.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tarn.functions.regex import re_matches
from tarn.functions.timefn import ORIGIN_US

_MARK = "tarn.functions"
_TOKENS = r"filter(split(lower(f), '[^\\p{L}\\p{N}]+'), t -> char_length(t) BETWEEN 2 AND 64)"
_ARRAY = "try_cast(try_parse_json(j) AS ARRAY<VARIANT>)"
_TEXT = "coalesce(CAST(v AS STRING), 'null')"
# A string that ends up in JSON: to_json quotes and escapes it.
_KIND = "CASE WHEN is_variant_null(v) THEN 'null' WHEN schema_of_variant(v) IN ('STRING', 'BOOLEAN') THEN schema_of_variant(v) WHEN schema_of_variant(v) RLIKE '^(BIGINT|DOUBLE|DECIMAL)' THEN 'NUMBER' ELSE 'other' END"


def _sorted(descending: bool) -> str:
    """Elements of one scalar kind in order, as JSON; mixed or nested kinds give null."""
    items = "transform(a, v -> struct({key} AS k, to_json(v) AS t))"
    done = "array_sort({items})".format(items="{items}")
    arms = []
    for kind, cast in (("NUMBER", "DOUBLE"), ("STRING", "STRING"), ("BOOLEAN", "BOOLEAN")):
        ordered = done.format(items=items.format(key=f"CAST(v AS {cast})"))
        ordered = f"reverse({ordered})" if descending else ordered
        arms.append(f"WHEN forall(a, v -> {_KIND} = '{kind}') THEN concat('[', array_join(transform({ordered}, x -> x.t), ','), ']')")
    return f"(SELECT CASE WHEN a IS NULL OR size(a) = 0 THEN NULL {' '.join(arms)} END FROM (SELECT {_ARRAY} AS a))"


#: name -> (parameters, result type, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    # Text
    "str_match": ("f STRING, v STRING", "BOOLEAN", "contains(f, v)"),
    "str_match_ignore_case": ("f STRING, v STRING", "BOOLEAN", "contains(lower(f), lower(v))"),
    "match_field": ("f STRING, v STRING", "BOOLEAN", "contains(f, v)"),
    "match_field_ignore_case": ("f STRING, v STRING", "BOOLEAN", "contains(lower(f), lower(v))"),
    "text_tokens": ("f STRING", "ARRAY<STRING>", _TOKENS),
    # The needle is taken as it is.
    "fuzzy_match": ("f STRING, v STRING, d INT", "BOOLEAN", f"exists({_TOKENS}, t -> abs(char_length(t) - char_length(v)) <= d AND levenshtein(t, v, d) >= 0)"),
    "re_match": ("f STRING, p STRING", "BOOLEAN", "f RLIKE p"),
    "re_not_match": ("f STRING, p STRING", "BOOLEAN", "NOT (f RLIKE p)"),
    # JSON arrays
    "arrsort": ("j STRING", "STRING", _sorted(False)),
    "arr_descending": ("j STRING", "STRING", _sorted(True)),
    "arrjoin": ("j STRING, d STRING", "STRING", f"array_join(transform({_ARRAY}, v -> {_TEXT}), d)"),
    # Null or no array counts 0.
    "arrcount": ("j STRING", "BIGINT", f"CAST(coalesce(array_size({_ARRAY}), 0) AS BIGINT)"),
    # From start to end, both counted from 0 and included; past the end: [].
    "arrindex": (
        "j STRING, s INT, e INT", "STRING",
        f"(SELECT concat('[', array_join(transform(CASE WHEN s >= size(a) OR e < s THEN slice(a, 1, 0) ELSE slice(a, s + 1, e - s + 1) END, v -> to_json(v)), ','), ']') FROM (SELECT {_ARRAY} AS a))",
    ),
    # Pairs up to the shorter array's end; null where either is empty.
    "arrzip": (
        "j STRING, k STRING, d STRING", "STRING",
        f"(SELECT CASE WHEN n > 0 THEN to_json(zip_with(slice(a, 1, n), slice(b, 1, n), (x, y) -> concat(x, d, y))) END FROM (SELECT a, b, least(size(a), size(b)) AS n FROM (SELECT transform({_ARRAY}, v -> {_TEXT}) AS a, transform({_ARRAY.replace('(j)', '(k)')}, v -> {_TEXT}) AS b)))",
    ),
    "cast_to_arr": ("j STRING", "ARRAY<STRING>", f"(SELECT CASE WHEN size(a) > 0 THEN filter(transform(a, v -> {_TEXT}), x -> x <> '') END FROM (SELECT {_ARRAY} AS a))"),
    "to_array_string": ("a ARRAY<STRING>", "STRING", "to_json(array_compact(a))"),
    # d is a set of delimiter characters; null splits into characters.
    "string_to_array_v2": (
        "s STRING, d STRING", "ARRAY<STRING>",
        r"CASE WHEN d IS NULL THEN filter(split(s, ''), x -> x <> '') WHEN d = '' THEN array(s) ELSE filter(split(s, concat('[', regexp_replace(d, '(.)', '\\\\$1'), ']')), x -> x <> '') END",
    ),
    # A dotted path over objects; a JSON null is 'null', a missing key null.
    "spath": (
        "j STRING, p STRING", "STRING",
        "(SELECT CASE WHEN v IS NULL THEN NULL WHEN is_variant_null(v) THEN 'null' ELSE CAST(v AS STRING) END FROM (SELECT try_variant_get(try_parse_json(j), concat('$.', p), 'variant') AS v))",
    ),
    # Time; a value's unit is told by its size, 0 is now
    "time_us": (
        "x BIGINT", "BIGINT",
        "CASE WHEN x = 0 THEN unix_micros(current_timestamp()) WHEN abs(x) >= 1000000000000000000 THEN x DIV 1000 WHEN abs(x) >= 1000000000000000 THEN x WHEN abs(x) >= 1000000000000 THEN x * 1000 ELSE x * 1000000 END",
    ),
    "text_us": (
        "x STRING", "BIGINT",
        "CASE WHEN x RLIKE '^-?[0-9]+$' THEN time_us(try_cast(x AS BIGINT)) ELSE unix_micros(coalesce(try_to_timestamp(x), try_to_timestamp(x, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\"), try_to_timestamp(regexp_replace(x, '^[A-Za-z]{3}, *', ''), 'd MMM yyyy HH:mm:ss Z'))) END",
    ),
    "cast_to_timestamp": ("x STRING", "BIGINT", "text_us(x)"),
    # Half-open; a negative bound is open, an unreadable one gives null.
    "time_range": (
        "t BIGINT, s STRING, e STRING", "BOOLEAN",
        "CASE WHEN s LIKE '-%' AND e LIKE '-%' THEN true WHEN s LIKE '-%' THEN t < text_us(e) WHEN e LIKE '-%' THEN t >= text_us(s) ELSE t >= text_us(s) AND t < text_us(e) END",
    ),
    "bucket_us": ("t BIGINT, w BIGINT", "BIGINT", f"{ORIGIN_US} + CAST(floor((t - {ORIGIN_US}) / w) AS BIGINT) * w"),
    # Library names that Spark lacks
    "strpos": ("s STRING, t STRING", "INT", "instr(s, t)"),
    "starts_with": ("s STRING, t STRING", "BOOLEAN", "startswith(s, t)"),
    "ends_with": ("s STRING, t STRING", "BOOLEAN", "endswith(s, t)"),
    "substr_index": ("s STRING, d STRING, n INT", "STRING", "substring_index(s, d, n)"),
    "to_hex": ("n BIGINT", "STRING", "lower(hex(n))"),
    "iszero": ("x DOUBLE", "BOOLEAN", "x = 0"),
    "gcd": ("a BIGINT, b BIGINT", "BIGINT", "aggregate(sequence(1, 96), named_struct('x', abs(a), 'y', abs(b)), (s, i) -> named_struct('x', IF(s.y = 0, s.x, s.y), 'y', IF(s.y = 0, 0L, s.x % s.y)), s -> s.x)"),
    "lcm": ("a BIGINT, b BIGINT", "BIGINT", "CASE WHEN a = 0 OR b = 0 THEN 0 ELSE abs(a DIV gcd(a, b) * b) END"),
    "json_get_str": ("j STRING, k STRING", "STRING", "try_variant_get(try_parse_json(j), concat('$.', k), 'string')"),
    "json_get_int": ("j STRING, k STRING", "BIGINT", "try_variant_get(try_parse_json(j), concat('$.', k), 'bigint')"),
    "json_get_float": ("j STRING, k STRING", "DOUBLE", "try_variant_get(try_parse_json(j), concat('$.', k), 'double')"),
    "json_get_bool": ("j STRING, k STRING", "BOOLEAN", "try_variant_get(try_parse_json(j), concat('$.', k), 'boolean')"),
    "json_get_json": ("j STRING, k STRING", "STRING", "to_json(try_variant_get(try_parse_json(j), concat('$.', k), 'variant'))"),
    "json_get_array": ("j STRING, k STRING", "ARRAY<STRING>", "transform(try_variant_get(try_parse_json(j), concat('$.', k), 'array<variant>'), v -> to_json(v))"),
    "json_as_text": ("j STRING, k STRING", "STRING", "get_json_object(j, concat('$.', k))"),
    "json_contains": ("j STRING, k STRING", "BOOLEAN", "coalesce(array_contains(json_object_keys(j), k), false)"),
    "json_length": ("j STRING", "BIGINT", "CAST(coalesce(json_array_length(j), array_size(json_object_keys(j))) AS BIGINT)"),
    "array_element": ("a ARRAY<STRING>, i INT", "STRING", "try_element_at(a, i)"),
    "array_has": ("a ARRAY<STRING>, x STRING", "BOOLEAN", "array_contains(a, x)"),
    "array_has_all": ("a ARRAY<STRING>, b ARRAY<STRING>", "BOOLEAN", "size(array_except(b, a)) = 0"),
    "array_has_any": ("a ARRAY<STRING>, b ARRAY<STRING>", "BOOLEAN", "size(array_intersect(a, b)) > 0"),
    "array_to_string": ("a ARRAY<STRING>, d STRING", "STRING", "array_join(a, d)"),
    # A text that is not sealed, or with another key, gives null; a path names a key of a JSON object, which is opened in place.
    "encrypt": ("s STRING, k STRING", "STRING", "base64(aes_encrypt(s, unhex(left(sha2(k, 256), 32))))"),
    "decrypt": ("s STRING, k STRING", "STRING", "CAST(try_aes_decrypt(CASE WHEN s RLIKE '^[A-Za-z0-9+/]{38,}={0,2}$' AND char_length(s) % 4 = 0 THEN unbase64(s) END, unhex(left(sha2(k, 256), 32))) AS STRING)"),
    "decrypt_path": ("j STRING, p STRING, k STRING", "STRING", "decrypt(get_json_object(j, concat('$.', p)), k)"),
    "sha256": ("s STRING", "STRING", "sha2(s, 256)"),
    "sha512": ("s STRING", "STRING", "sha2(s, 512)"),
}


def register(spark: SparkSession) -> None:
    """Make every function of the engine known to the session, once."""
    if spark.conf.get(_MARK, "") == str(len(FUNCTIONS)):
        return
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udf.register("re_matches", re_matches)
    spark.conf.set(_MARK, str(len(FUNCTIONS)))
