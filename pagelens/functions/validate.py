"""Validators as predicates and as values with a reason for rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import urls
from .paths import is_safe_path

LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"


def is_url(v: Column) -> Column:
    return F.coalesce((urls.scheme(v) != "") & (urls.authority(v) != ""), F.lit(False))


def is_http_url(v: Column) -> Column:
    return F.coalesce(urls.scheme(v).isin("http", "https") & (urls.authority(v) != ""), F.lit(False))


def is_domain(v: Column) -> Column:
    return F.coalesce(v.rlike(rf"^{LABEL}(?:\.{LABEL})*\z"), F.lit(False))


def is_file_extension(v: Column, allowed: tuple[str, ...] | None = None) -> Column:
    ok = F.coalesce(v.rlike(r"^\.[a-zA-Z0-9]+\z"), F.lit(False))
    return ok & F.lower(v).isin(*[a.lower() for a in allowed]) if allowed else ok


def _checked(value: Column, ok: Column, reason: str) -> Column:
    return F.struct(F.when(ok, value).alias("value"), F.when(~ok, F.lit(reason)).alias("error"))


def checked_url(v: Column, allow_relative: bool = False) -> Column:
    """struct(value, error)."""
    ok = F.coalesce(v != "", F.lit(False))
    return _checked(v, ok if allow_relative else ok & is_http_url(v), "not a valid URL")


def checked_path(v: Column) -> Column:
    return _checked(v, F.coalesce(v != "", F.lit(False)) & is_safe_path(v), "not a safe path")


def checked_domain(v: Column) -> Column:
    return _checked(F.lower(v), is_domain(v), "not a valid domain")


def checked_size(v: Column, most: int | None = None) -> Column:
    """Numbers of 0 or more, truncated; up to ``most`` if that is positive."""
    n = v.try_cast("double")
    whole = F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("long")
    ok = F.coalesce(whole >= 0, F.lit(False))
    return _checked(whole, ok & (whole <= most) if most else ok, "not a valid size")


def checked_headers(h: Column) -> Column:
    """A map whose names are letters, digits, '-' and '_'; null is an empty map."""
    filled = F.coalesce(h, F.create_map().cast("map<string,string>"))
    return _checked(filled, F.forall(F.map_keys(filled), lambda k: k.rlike(r"^[a-zA-Z0-9\-_]+\z")), "not a valid header name")


def kind_of(value) -> str:
    """The kind of a JSON value."""
    kinds = ((bool, "flag"), (int, "whole number"), (float, "number"), (str, "text"), (list, "list"), (dict, "map"))
    return next((name for t, name in kinds if isinstance(value, t)), "null")


def _fits(kind, kinds):
    """A flag may stand for a whole number."""
    return kind in kinds or (kind == "flag" and "whole number" in kinds)


def checked_config(values: dict, schema: dict[str, tuple[str, ...]]) -> dict:
    """The keys of ``values`` that ``schema`` has; a value of none of its key's kinds is a TypeError."""
    if not isinstance(values, dict):
        raise TypeError(f"settings must be a map, not {kind_of(values)}")
    out = {k: v for k, v in values.items() if k in schema}
    for k, v in out.items():
        if not _fits(kind_of(v), schema[k]):
            raise TypeError(f"{k} must be {' or '.join(schema[k])}, not {kind_of(v)}")
    return out


def checked_configs(configs: DataFrame, schema: dict[str, tuple[str, ...]]) -> DataFrame:
    """(id, key, value, error) of a table of JSON texts (id, config): the keys that ``schema`` has, or one row with an error for a text that is no map."""
    parsed = configs.select("id", F.try_parse_json("config").alias("v"))
    shape = F.schema_of_variant("v")
    names = F.regexp_extract(shape, "^([A-Z]+)", 1)
    kind = F.create_map(*[F.lit(x) for pair in {"BOOLEAN": "flag", "BIGINT": "whole number", "DOUBLE": "number", "DECIMAL": "number", "STRING": "text", "ARRAY": "list", "OBJECT": "map", "VOID": "null"}.items() for x in pair])
    rows = parsed.filter(names == "OBJECT").select("id", F.explode(F.col("v").cast("map<string,variant>")).alias("key", "v")).withColumn("kind", kind[names])
    wanted = F.lit(None).cast("string")
    ok = F.lit(False)
    for key, kinds in schema.items():
        here = F.col("key") == key
        wanted = F.when(here, " or ".join(kinds)).otherwise(wanted)
        ok = ok | (here & F.col("kind").isin(*kinds, *(["flag"] if "whole number" in kinds else [])))
    each = rows.withColumn("wanted", wanted).filter("wanted IS NOT NULL").select("id", "key", F.when(ok, F.col("v").cast("string")).alias("value"), F.when(~ok, F.concat(F.lit("must be "), "wanted", F.lit(", not "), "kind")).alias("error"))
    bad = parsed.filter(F.coalesce(names != "OBJECT", F.lit(True))).select("id", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.lit("must be a map").alias("error"))
    return each.unionByName(bad)
