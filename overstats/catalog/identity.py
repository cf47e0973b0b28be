"""Queries about who is who."""

from __future__ import annotations

from pyspark.sql import functions as F

from overstats.catalog.base import pick, query, sql, two
from overstats.functions import geography, styles
from overstats.operators import identity, players
from overstats.session import materialise
from overstats.sources import metadata
from overstats.sources.tables import TEAMS, TYPE_CODES, _pick, _two

PEOPLE = {"people": f"""SELECT DISTINCT 'Player ' || LPAD(CAST(CAST(SUBSTR(person_id, 2) AS INT) % 50 AS VARCHAR), 2, '0') ||
 CASE WHEN match_id % 4 = 0 THEN ' Jr' ELSE '' END AS name, person_id, gender, team FROM nmx"""}


def _squads(t):
    number = F.substring("person_id", 2, 2).cast("int") % 50
    return players.squads_from_deliveries(t.mixed).withColumn(
        "name", F.concat(F.lit("Player "), _two(number),
                         F.when(F.col("match_id") % 4 == 0, " Jr").otherwise("")))


def _people(t):
    return materialise(identity.corpus_people(_squads(t)), "people")


@query(sql("SELECT name, COUNT(DISTINCT person_id) AS people FROM people GROUP BY 1 HAVING COUNT(DISTINCT person_id) > 1",
           "nm", mixed=True, extra=PEOPLE))
def ambiguous_names(t):
    return identity.ambiguous_names(_people(t))


@query(sql("""SELECT person_id, LIST_SORT(LIST(DISTINCT name)) AS names, LIST_SORT(LIST(DISTINCT team)) AS teams,
 LIST_SORT(LIST(DISTINCT gender)) AS genders FROM people GROUP BY 1""", "nm", mixed=True, extra=PEOPLE))
def person_facts(t):
    return identity.person_facts(_people(t))


def _register_rows(t):
    c = F.col
    k = c("c_custkey")
    return t.table("customer").select(
        F.concat(F.lit("p"), _two(k % 60)).alias("identifier"),
        F.concat(F.lit("x"), (k % 97).cast("string")).alias("key_cricinfo"),
        F.when(k % 3 == 0, F.concat(F.lit("y"), k.cast("string"))).otherwise("").alias("key_cricinfo_2"))


REGISTER = f"""SELECT external_id, MIN(person_id) AS person_id FROM (
 SELECT 'p' || {two('c_custkey % 60')} AS person_id, 'x' || CAST(c_custkey % 97 AS VARCHAR) AS external_id FROM customer
 UNION SELECT 'p' || {two('c_custkey % 60')}, 'y' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0)
GROUP BY 1 HAVING COUNT(DISTINCT person_id) = 1"""


@query(REGISTER)
def people_register(t):
    """External ids that lead to one person."""
    return metadata.unambiguous_register(_register_rows(t)).select("external_id", "person_id")


def _layer(rows, key):
    """A metadata layer read off a table: names, ids, countries by number."""
    k = F.col(key)
    code = _pick(TYPE_CODES, k % 10)
    return rows.select(
        F.concat(F.lit("Player "), _two(k % 75), F.when(k % 2 == 0, " Jr").otherwise("")).alias("name"),
        code.alias("bowling_type"), F.when(k % 3 == 0, "left").otherwise("right").alias("batting_hand"),
        F.lit("Bowler").alias("role"), _pick(TEAMS, k % 8).alias("country"),
        F.when(k % 5 == 1, F.concat(F.lit("y"), (k % 12).cast("string"))).otherwise("").alias("external_id"),
        F.concat(F.lit("Full "), k.cast("string")).alias("full_name"),
        F.when(k % 7 == 0, F.concat(F.lit("p"), _two(k % 20))).otherwise("").alias("row_id"),
        k.alias("row_no"))


def _layer_sql(table: str, key: str) -> str:
    return f"""SELECT 'Player ' || {two(f'{key} % 75')} || CASE WHEN {key} % 2 = 0 THEN ' Jr' ELSE '' END AS name,
 {pick(TYPE_CODES, f'{key} % 10')} AS bowling_type, {pick(TEAMS, f'{key} % 8')} AS country, {key} AS row_no, 'Full ' || {key} AS full_name,
 CASE WHEN {key} % 7 = 0 THEN 'p' || {two(f'{key} % 20')} ELSE COALESCE((SELECT person_id FROM reg WHERE {key} % 5 = 1 AND external_id = 'y' || CAST({key} % 12 AS VARCHAR)), '') END AS row_person
 FROM {table}"""


def _layer_hits(n: int) -> dict[str, str]:
    return {
        f"pin{n}": f"SELECT row_person AS person_id, MIN(row_no) AS row_no FROM lay{n} WHERE row_person <> '' GROUP BY 1",
        f"try{n}": f"""SELECT pn.person_id, pn.name, l.row_no, CASE WHEN (SELECT COUNT(DISTINCT q.person_id) FROM people q WHERE q.name = pn.name) > 1 THEN 'ambiguous_name'
   WHEN (SELECT COUNT(*) FROM lay{n} r WHERE r.name = pn.name) > 1 THEN 'duplicate_rows'
   WHEN NOT EXISTS (SELECT 1 FROM people q WHERE q.person_id = pn.person_id AND q.team = l.country) THEN 'country_mismatch' END AS reason
  FROM (SELECT DISTINCT person_id, name FROM people) pn JOIN (SELECT name, MIN(row_no) AS row_no, ARG_MIN(country, row_no) AS country
    FROM lay{n} WHERE row_person = '' GROUP BY 1) l ON l.name = pn.name WHERE pn.person_id NOT IN (SELECT person_id FROM pin{n})""",
        f"hit{n}": f"""SELECT person_id, {n} AS layer, 'id' AS via, row_no FROM pin{n} WHERE person_id IN (SELECT person_id FROM people)
  UNION ALL SELECT person_id, {n}, 'name', ARG_MIN(row_no, name) FROM try{n} WHERE reason IS NULL GROUP BY person_id""",
        f"ref{n}": f"""SELECT DISTINCT t.person_id, reason FROM try{n} t LEFT JOIN (SELECT person_id, MIN(name) AS good FROM try{n} WHERE reason IS NULL GROUP BY 1) g
  ON g.person_id = t.person_id WHERE reason IS NOT NULL AND (good IS NULL OR t.name < good)""",
    }


RESOLVE = PEOPLE | {"reg": REGISTER, "lay0": _layer_sql("supplier", "s_suppkey"), "lay1": _layer_sql("(SELECT * FROM part)", "p_partkey")} \
    | _layer_hits(0) | _layer_hits(1) | {
        "best": """SELECT person_id, layer, via, row_no FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY layer DESC) AS rn
  FROM (SELECT * FROM hit0 UNION ALL SELECT * FROM hit1)) WHERE rn = 1"""}


def _resolve(t):
    layers = [_layer(t.table("supplier"), "s_suppkey"), _layer(t.table("part"), "p_partkey")]
    register = metadata.unambiguous_register(_register_rows(t))
    return identity.resolve_metadata(_people(t), layers, register)


@query(sql("""SELECT b.person_id, via, full_name, bowling_type, country FROM best b JOIN lay0 l USING (row_no) WHERE layer = 0
UNION ALL SELECT b.person_id, via, full_name, bowling_type, country FROM best b JOIN lay1 l USING (row_no) WHERE layer = 1""",
           "nm", mixed=True, extra=RESOLVE))
def resolved_metadata(t):
    """Metadata layers attached by id, else by unambiguous name."""
    return _resolve(t)[0].select("person_id", "via", "full_name", "bowling_type", "country")


@query(sql("""SELECT person_id, LIST_SORT(LIST(DISTINCT reason)) AS reasons FROM (SELECT * FROM ref0 UNION ALL SELECT * FROM ref1)
WHERE person_id NOT IN (SELECT person_id FROM best) GROUP BY 1""", "nm", mixed=True, extra=RESOLVE))
def unresolved_metadata(t):
    return _resolve(t)[1]


def _bridge_register(t):
    k = F.col("c_custkey")
    return t.table("customer").select(
        F.concat(F.lit("n"), (k % 331).cast("string")).alias("person_id"),
        F.concat(F.lit("y"), k.cast("string")).alias("external_id"))


def _claims(t):
    k = F.col("o_orderkey")
    return t.table("orders").select(
        F.concat(F.lit("y"), (k % 1200).cast("string")).alias("external_id"),
        F.concat(F.lit("Q"), F.when(k % 1200 % 5 == 0, k % 30).otherwise(k % 1200 % 700)
                 .cast("string")).alias("item"),
        F.when(k % 2 == 0, F.concat(F.lit("image"), (k % 11).cast("string"))).alias("image"))


BRIDGE = {
    "reg": """SELECT DISTINCT 'n' || CAST(c_custkey % 331 AS VARCHAR) AS person_id, 'y' || CAST(c_custkey AS VARCHAR) AS external_id
      FROM customer""",
    "clm": """SELECT 'y' || CAST(o_orderkey % 1200 AS VARCHAR) AS external_id, 'Q' || CAST(CASE WHEN o_orderkey % 1200 % 5 = 0 THEN o_orderkey % 30
   ELSE o_orderkey % 1200 % 700 END AS VARCHAR) AS item, CASE WHEN o_orderkey % 2 = 0 THEN 'image' || CAST(o_orderkey % 11 AS VARCHAR) END AS image FROM orders""",
    "ids": "SELECT external_id, COUNT(DISTINCT item) AS items, MIN(item) AS item, MIN(image) AS image FROM clm GROUP BY 1",
    "j": "SELECT person_id, external_id, items, item, image FROM reg JOIN ids USING (external_id)",
    "per": """SELECT person_id, COUNT(DISTINCT item) AS items, MIN(item) AS item, ARG_MAX(image, external_id) FILTER (WHERE image IS NOT NULL) AS imgx,
      FIRST(image ORDER BY external_id DESC) AS image FROM j WHERE items = 1 GROUP BY 1""",
    "one": "SELECT person_id, item, image FROM per WHERE items = 1",
    "shared": "SELECT item FROM one GROUP BY 1 HAVING COUNT(*) > 1",
}


@query(
       "WITH " + ", ".join(f"{k} AS ({v})" for k, v in BRIDGE.items())
       + " SELECT person_id, item, image FROM one WHERE item NOT IN (SELECT item FROM shared)")
def identity_bridge(t):
    return identity.bridge(_bridge_register(t), _claims(t))[0]


@query("WITH " + ", ".join(f"{k} AS ({v})" for k, v in BRIDGE.items())
       + """ SELECT 'external id on two or more items' AS reason, COUNT(DISTINCT external_id) AS n FROM j WHERE items > 1
 UNION ALL SELECT 'person''s ids lead to different items', COUNT(*) FROM per WHERE items > 1
 UNION ALL SELECT 'item leads to two or more people', COUNT(*) FROM one WHERE item IN (SELECT item FROM shared)""")
def identity_bridge_skips(t):
    return identity.bridge(_bridge_register(t), _claims(t))[1]


RAW_STYLES = ("Right arm Fast medium", "RFM", "Slow Left arm Orthodox", "Legbreak googly", "Left-arm wrist spin",
              "chinaman", "Right arm Offbreak", "Left arm medium", "Right arm", "lf", "SLA", "pace bowler",
              "left arm quick", "Right-arm slow", "wicketkeeper", "N/A", "Right arm Medium, Right arm Offbreak")
CODES = ("rfm", "rfm", "sla", "lb", "slc", "slc", "ob", "lm", "rm", "lf", "sla", "rf", "lf", "ob", "", "", "rm")


@query(f"""SELECT s_suppkey, style, code, CASE WHEN code IN ('') THEN '' WHEN code IN ('ob', 'lb', 'sla', 'slc') THEN 'spin' ELSE 'pace' END AS family,
 CASE WHEN code = '' THEN '' WHEN code IN ('ob', 'lb', 'sla', 'slc') THEN CASE WHEN (code IN ('ob', 'slc')) = (s_suppkey % 2 = 0) THEN 'turns into the batter' ELSE 'turns away from the batter' END
  WHEN (code LIKE 'l%') = (s_suppkey % 2 = 0) THEN 'angles into the batter' ELSE 'shapes away from the batter' END AS note
FROM (SELECT s_suppkey, {pick(RAW_STYLES, f's_suppkey % {len(RAW_STYLES)}')} AS style, {pick(CODES, f's_suppkey % {len(CODES)}')} AS code FROM supplier)""")
def bowling_styles(t):
    """Free-text styles of every supplier on the fixed taxonomy."""
    c = F.col
    rows = t.table("supplier").select(
        "s_suppkey", _pick(RAW_STYLES, c("s_suppkey") % len(RAW_STYLES)).alias("style"))
    code = styles.bowling_style(styles.primary_style(c("style")))
    hand = F.when(c("s_suppkey") % 2 == 0, "right").otherwise("left")
    return rows.withColumn("code", code).select(
        "s_suppkey", "style", "code", styles.bowling_family(c("code")).alias("family"),
        styles.matchup_note(c("code"), hand).alias("note"))


@query(f"""SELECT name, bowling_type, CASE WHEN c_custkey % 4 = 0 THEN 'left' WHEN c_custkey % 4 = 1 THEN 'right' ELSE '' END AS batting_hand FROM (
 SELECT c_custkey, c_name AS name, {pick(CODES, f'c_custkey % {len(CODES)}')} AS bowling_type FROM customer WHERE c_custkey % 10 <> 0)
WHERE bowling_type <> '' OR c_custkey % 4 < 2""")
def converted_metadata(t):
    """An exported player table cleaned into style rows."""
    return metadata.convert_metadata(_export(t))[0].select("name", "bowling_type", "batting_hand")


@query(f"""SELECT style, COUNT(*) AS n FROM (SELECT {pick(RAW_STYLES, f'c_custkey % {len(RAW_STYLES)}')} AS style FROM customer WHERE c_custkey % 10 <> 0)
WHERE style = 'wicketkeeper' GROUP BY 1""")
def unrecognised_styles(t):
    return metadata.convert_metadata(_export(t))[1]


def _export(t):
    c = F.col
    k = c("c_custkey")
    return t.table("customer").select(
        F.when(k % 10 == 0, "NULL").otherwise(c("c_name")).alias("unique_name"),
        F.lit("-").alias("cricsheet_id"), _pick(RAW_STYLES, k % len(RAW_STYLES)).alias("bowling_style"),
        F.when(k % 4 == 0, "Left-hand bat").when(k % 4 == 1, "RHB").otherwise("none").alias("batting_style"),
        F.lit("Bowler").alias("playing_role"), F.lit("NA").alias("country"),
        F.lit("").alias("cricinfo_id"), c("c_name").alias("full_name"))


COUNTRIES = ("Barbados", "Wales", "UAE", "India", "", "USA", "Northern Ireland", "France")
STANDS = ("West Indies", "England", "United Arab Emirates", "India", "", "United States of America", "Ireland", "France")


@query(f"""SELECT c_custkey, country, (stands <> '' AND stands IN (t1, t2)) AS matches FROM (
 SELECT c_custkey, {pick(COUNTRIES, f'c_custkey % {len(COUNTRIES)}')} AS country, {pick(STANDS, f'c_custkey % {len(STANDS)}')} AS stands,
 {pick(TEAMS, 'c_nationkey % 8')} AS t1, {pick(STANDS, 'c_custkey % 3')} AS t2 FROM customer)""")
def country_matches(t):
    c = F.col
    return t.table("customer").select(
        "c_custkey", _pick(COUNTRIES, c("c_custkey") % len(COUNTRIES)).alias("country"),
        F.array(_pick(TEAMS, c("c_nationkey") % 8), _pick(STANDS, c("c_custkey") % 3)).alias("teams"),
    ).select("c_custkey", "country",
             geography.country_matches(c("country"), c("teams")).alias("matches"))


@query(f"""SELECT match_id, COUNT(*) AS files, LIST_SORT(LIST(DISTINCT fmt)) AS formats FROM (
 SELECT o_custkey AS match_id, CASE WHEN o_orderkey % 3 = 0 THEN 'odi' ELSE 't20i' END AS fmt FROM orders) GROUP BY 1 HAVING COUNT(*) > 1""")
def duplicate_match_ids(t):
    c = F.col
    return identity.duplicate_match_ids(t.table("orders").select(
        c("o_custkey").alias("match_id"), F.when(c("o_orderkey") % 3 == 0, "odi").otherwise("t20i").alias("fmt")))
