"""Manifests of builds, of every schema version, as semi-structured values.

A manifest says which build a dataset is and how its numbers are to be read. Older builds lack parts of it and key formats
by name alone; they are brought to one shape here, so that nothing behind has to know versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overstats import config as C

#: Schema versions that are read; a manifest without one is of the first.
VERSIONS = (1, 2)
# --- fixed values: gates that the first version didn't store ----------------
THRESHOLD_DEFAULTS = {"teamMinMatches": 5, "venueMinInnings": 3}
#: Facts of a format that readers get, by their names in the manifest.
FORMAT_FACTS = {"label": "string", "matches": "bigint", "players": "bigint", "deliveries": "bigint", "firstDate": "string", "lastDate": "string"}


def _at(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def normalised(builds: DataFrame, column: str = "manifest") -> DataFrame:
    """``builds`` with its manifests (JSON texts) in the newest shape, in place of ``column``.

    Adds version, build_id, generated, fingerprint, player_count, match_count, formats (map of format key to the format's
    values), thresholds (defaults where there are none), and phases, bowling_types, sources, provenance as they were (JSON,
    null if absent). Formats keyed by name alone are men's. A text that is no JSON, or a version that isn't known, fails the
    job; a null text gives nulls.
    """
    c = F.col
    parsed = builds.withColumn("_m", F.parse_json(column))
    given = F.coalesce(_at(c("_m"), "schemaVersion", "int"), F.lit(1))
    said = _at(c("_m"), "schemaVersion", "string")
    version = F.when(c("_m").isNull(), F.lit(None).cast("int")).when(given.isin(*VERSIONS) & (said.isNull() | said.isin(*map(str, VERSIONS))), given).otherwise(
        F.raise_error(F.concat(F.lit("unknown manifest version "), said)).cast("int"))
    generated = _at(c("_m"), "generated", "string")
    formats = F.map_filter(F.coalesce(_at(c("_m"), "formats", "map<string, variant>"), F.create_map().cast("map<string, variant>")),
                           lambda _, v: v.isNotNull() & ~F.is_variant_null(v))

    def values(name: Column, v: Column) -> Column:
        plain = name.isin(*C.CORE_FORMATS)
        return F.struct(
            F.when(plain, F.concat(name, F.lit("-m"))).otherwise(F.coalesce(_at(v, "formatKey", "string"), name)).alias("format_key"),
            F.when(plain, name).otherwise(_at(v, "format", "string")).alias("format"),
            F.when(plain, F.lit("male")).otherwise(_at(v, "gender", "string")).alias("gender"),
            *[_at(v, k, kind).alias(k) for k, kind in FORMAT_FACTS.items()])

    rekeyed = F.map_from_entries(F.transform(F.map_entries(formats), lambda e: F.struct(
        F.when(e["key"].isin(*C.CORE_FORMATS), F.concat(e["key"], F.lit("-m"))).otherwise(e["key"]), values(e["key"], e["value"]))))
    stored = F.coalesce(_at(c("_m"), "thresholds", "map<string, double>"), F.create_map().cast("map<string, double>"))
    defaults = F.create_map(*[F.lit(x) for k, v in THRESHOLD_DEFAULTS.items() for x in (k, float(v))])
    missing = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(stored, k))
    raw = lambda path: F.to_json(_at(c("_m"), path, "variant"))
    return parsed.withColumns({
        "version": version, "build_id": F.coalesce(_at(c("_m"), "buildId", "string"), F.concat(generated, F.lit("-v1"))),
        "generated": generated, "fingerprint": _at(c("_m"), "fingerprint", "string"),
        "player_count": _at(c("_m"), "playerCount", "bigint"), "match_count": _at(c("_m"), "matchCount", "bigint"),
        "formats": rekeyed, "thresholds": F.map_concat(stored, missing), "phases": raw("phases"),
        "bowling_types": raw("bowlingTypes"), "sources": raw("sources"), "provenance": raw("provenance"),
    }).drop("_m", *([column] if column not in ("formats", "version") else []))


def dataset_meta(runs: DataFrame) -> DataFrame:
    """What readers are told of the dataset they see: the manifest of the latest complete run, in one row.

    ``runs`` has run_id, status, finished_at and manifest. Partial and failed runs never count. The data are as new as the
    newest match of any format, or as the build if no format says.
    """
    c = F.col
    latest = runs.where(c("status") == "complete").orderBy(F.desc("finished_at"), F.desc("run_id")).limit(1)
    found = normalised(latest)
    newest = F.array_max(F.transform(F.map_values("formats"), lambda f: f["lastDate"]))
    return found.select(
        "build_id", c("generated").alias("generated_at"), c("finished_at").alias("imported_at"), c("version").alias("schema_version"),
        "formats", "thresholds", F.coalesce(F.when(newest != "", newest), F.substring("generated", 1, 10)).alias("data_as_of"),
        "fingerprint", "phases", "bowling_types", "sources", "provenance", "player_count", "match_count")
