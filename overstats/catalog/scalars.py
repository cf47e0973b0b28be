"""Queries over identifiers, notation, text rules and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from overstats.catalog.base import PHASE, pick, query, ratio, sql
from overstats.functions import flags, geography, rates, text
from overstats.sources.tables import _pick


@query("""SELECT c_custkey, TRIM(REGEXP_REPLACE(LOWER(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
 TRIM(REGEXP_REPLACE(LOWER(c_name), '[^a-z0-9]+', '-', 'g'), '-') || '-' || SUBSTR(CAST(c_custkey * 1000003 AS VARCHAR), 1, 8) AS person_slug,
 TRIM(REGEXP_REPLACE(LOWER(c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') || CASE WHEN c_custkey % 2 = 0 THEN '-w' ELSE '-m' END AS team_id,
 CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' Women' ELSE c_mktsegment END AS team_label,
 'odi' || CASE WHEN c_custkey % 2 = 0 THEN '-w' ELSE '-m' END AS format_key FROM customer""")
def identifiers(t):
    c = F.col
    gender = F.when(c("c_custkey") % 2 == 0, "female").otherwise("male")
    return t.table("customer").select(
        "c_custkey", text.slug_text(c("c_name")).alias("slug"),
        text.person_slug(c("c_name"), (c("c_custkey") * 1000003).cast("string")).alias("person_slug"),
        text.team_id(c("c_mktsegment"), gender).alias("team_id"),
        text.team_label(c("c_mktsegment"), gender).alias("team_label"),
        text.format_key(F.lit("odi"), gender).alias("format_key"))


@query("""SELECT o_orderkey, CAST(balls // 6 AS VARCHAR) || '.' || CAST(balls % 6 AS VARCHAR) AS overs_text,
 CASE WHEN balls % 6 = 0 THEN CAST(balls // 6 AS VARCHAR) ELSE CAST(balls // 6 AS VARCHAR) || '.' || CAST(balls % 6 AS VARCHAR) END AS notation,
 balls AS back FROM (SELECT o_orderkey, o_custkey % 700 AS balls FROM orders)""")
def overs_notation(t):
    balls = F.col("balls")
    rows = t.table("orders").select("o_orderkey", (F.col("o_custkey") % 700).alias("balls"))
    as_number = text.overs_text(balls).cast("double")
    return rows.select("o_orderkey", text.overs_text(balls).alias("overs_text"),
                       text.overs_notation(balls).alias("notation"),
                       text.overs_to_balls(as_number).alias("back"))


@query(sql(f"SELECT match_id, innings, seq, fmt, over_no AS over, {PHASE.format(f='fmt', o='over_no')} AS phase FROM dx", "d", mixed=True))
def phases(t):
    return t.mixed.select("match_id", "innings", "seq", "fmt", "over",
                          flags.phase_of(F.col("fmt"), F.col("over")).alias("phase"))


@query(sql("""SELECT fmt, phase, label, COUNT(*) AS balls FROM (SELECT fmt, phase, CASE WHEN fmt = 'test' THEN CASE phase WHEN 'new_ball' THEN 'New ball (1-20)'
   WHEN 'old_ball' THEN 'Old ball (21-80)' ELSE 'Second new ball (81+)' END
  WHEN fmt = 'odi' THEN CASE phase WHEN 'powerplay' THEN 'Powerplay (1-10)' WHEN 'middle' THEN 'Middle (11-40)' ELSE 'Death (41-50)' END
  ELSE CASE phase WHEN 'powerplay' THEN 'Powerplay (1-6)' WHEN 'middle' THEN 'Middle (7-15)' ELSE 'Death (16-20)' END END AS label FROM dx) GROUP BY 1, 2, 3""",
           "d", mixed=True))
def phase_labels(t):
    rows = t.mixed.select("fmt", "phase", text.subject_label(
        F.col("fmt"), F.lit("phase"), F.col("phase")).alias("label"))
    return rows.groupBy("fmt", "phase", "label").agg(F.count(F.lit(1)).alias("balls"))


MISSING = ('["umpires"]', '["player_of_match","umpires","player_of_match"]', '[{"powerplays":{"2":["fielding"]}}]', "[]")
NAMES = ("umpires", "player_of_match,umpires", "powerplays", "")


@query(f"SELECT o_orderkey, {pick(NAMES, 'o_orderkey % 4')} AS missing FROM orders")
def missing_fields(t):
    raw = F.from_json(_pick(MISSING, F.col("o_orderkey") % 4), "array<string>")
    return t.table("orders").select(
        "o_orderkey", F.array_join(text.missing_fields(raw), ",").alias("missing"))


@query("""SELECT doc_id, line, COALESCE(name <> '' AND NOT REGEXP_MATCHES(name, '(^| )(nc|nd)( |$)') AND REGEXP_FULL_MATCH(name,
  '(cc0|cc zero)( [0-9]+(\\.[0-9]+)?)?( universal)?|(public domain|pd|pdm)( .*)?|cc by( sa)?( [0-9]+(\\.[0-9]+)?)?( [a-z]+)*|godl( india)?'), FALSE) AS accepted
FROM (SELECT doc_id, line, TRIM(REGEXP_REPLACE(REPLACE(REPLACE(REGEXP_REPLACE(LOWER(line), '^.*(licensed under|released under) ', ''), '-', ' '), '_', ' '), '\\s+', ' ', 'g')) AS name
 FROM (SELECT doc_id, UNNEST(STRING_SPLIT(text, CHR(10))) AS line FROM documents) WHERE CONTAINS(LOWER(line), 'licensed under ') OR CONTAINS(LOWER(line), 'released under '))""")
def licence_lines(t):
    """Licence lines of whole documents, classified by the licence they name."""
    lines = t.table("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    low = F.lower("line")
    named = lines.where(low.contains("licensed under ") | low.contains("released under "))
    name = F.regexp_replace(F.lower("line"), "^.*(licensed under|released under) ", "")
    return named.select("doc_id", "line", text.licence_accepted(name).alias("accepted"))


@query(sql(f"""SELECT batting_team, n, runs, CASE WHEN n > 0 THEN (n / (n + CAST(200 AS DOUBLE))) * avg_runs + (CAST(1 AS DOUBLE) - n / (n + CAST(200 AS DOUBLE))) * CAST(7.5 AS DOUBLE) END AS shrunk,
 CASE WHEN n >= 3000 THEN 'high' WHEN n >= 1000 * CAST(1.5 AS DOUBLE) THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT batting_team, COUNT(*) AS n, CAST(SUM(runs_total) AS BIGINT) AS runs, {ratio('CAST(SUM(runs_total) AS BIGINT)', 'COUNT(*)', 6)} AS avg_runs FROM d GROUP BY 1)""", "d"))
def shrinkage(t):
    c = F.col
    rows = t.deliveries.groupBy("batting_team").agg(
        F.count(F.lit(1)).alias("n"), flags.total(c("runs_total")).alias("runs"))
    average = rates.ratio(c("runs"), c("n"), 6)
    return rows.select("batting_team", "n", "runs",
                       rates.shrink(average, F.lit(7.5), c("n"), 200.0).alias("shrunk"),
                       rates.confidence(c("n"), F.lit(1000)).alias("confidence"))


@query(sql("""SELECT match_id, innings, seq, wicket, kind, CASE WHEN kind NOT IN ('caught', 'bowled', 'lbw') THEN kind
 WHEN kind = 'bowled' THEN 'b Player ' || SUBSTR(bowler_id, 2) ELSE kind || ' b Player ' || SUBSTR(bowler_id, 2) END AS label
FROM (SELECT match_id, innings, seq, bowler_id, CAST(0 AS BIGINT) AS wicket, kind1 AS kind FROM d UNION ALL
 SELECT match_id, innings, seq, bowler_id, CAST(1 AS BIGINT), kind2 FROM d) WHERE kind IS NOT NULL""", "d"))
def dismissal_labels(t):
    kind = F.col("out.kind")
    return t.deliveries.select("match_id", "innings", "seq", "bowler", F.posexplode("wickets").alias("wicket", "out")).select(
        "match_id", "innings", "seq", F.col("wicket").cast("bigint").alias("wicket"), kind.alias("kind"),
        text.dismissal_label(kind, F.col("bowler")).alias("label"))


@query(sql("""SELECT DISTINCT venue, city, TRIM(SPLIT_PART(venue, ',', 1)) AS ground,
 CASE TRIM(city) WHEN 'Bangalore' THEN 'Bengaluru' WHEN 'Barbados' THEN '' ELSE TRIM(city) END AS normal_city FROM d""", "d"))
def grounds(t):
    c = F.col
    ground = geography.canonical_venue(c("venue"))
    return t.deliveries.select("venue", "city").distinct().select(
        "venue", "city", ground.alias("ground"),
        geography.normal_city(ground, c("city")).alias("normal_city"))


@query("""SELECT named, COUNT(*) AS lines, COUNT(DISTINCT doc_id) AS documents, COALESCE(name <> '' AND NOT REGEXP_MATCHES(name, '(^| )(nc|nd)( |$)') AND REGEXP_FULL_MATCH(name,
  '(cc0|cc zero)( [0-9]+(\\.[0-9]+)?)?( universal)?|(public domain|pd|pdm)( .*)?|cc by( sa)?( [0-9]+(\\.[0-9]+)?)?( [a-z]+)*|godl( india)?'), FALSE) AS accepted
FROM (SELECT doc_id, named, TRIM(REGEXP_REPLACE(REPLACE(REPLACE(named, '-', ' '), '_', ' '), '\\s+', ' ', 'g')) AS name
 FROM (SELECT doc_id, REGEXP_REPLACE(LOWER(line), '^.*(licensed under|released under) ', '') AS named FROM (SELECT doc_id, UNNEST(STRING_SPLIT(text, CHR(10))) AS line FROM documents)
  WHERE CONTAINS(LOWER(line), 'licensed under ') OR CONTAINS(LOWER(line), 'released under '))) GROUP BY named, name""")
def licences(t):
    """The licences that documents name, how often, and whether they are accepted."""
    low = F.lower("line")
    lines = t.table("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    named = lines.where(low.contains("licensed under ") | low.contains("released under ")).withColumn(
        "named", F.regexp_replace(low, "^.*(licensed under|released under) ", ""))
    return named.groupBy("named").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("doc_id").alias("documents")).withColumn(
        "accepted", text.licence_accepted(F.col("named")))
