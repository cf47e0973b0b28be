"""Queries of the read layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from overstats.catalog.base import query, sql, total
from overstats.catalog.cohorts import claims_sql, judged, profile_sql
from overstats.catalog.matches import RECORD, match_rows
from overstats.catalog.models import given_model
from overstats.catalog.players import TOTAL_RATES, TOTALS, careers_table
from overstats.functions import text
from overstats.operators import cohort, players, ranking, state, teams
from overstats.plans import read
from overstats.session import materialise, scratch_dir

TEAM_LIST = "['India', 'Australia', 'England', 'Pakistan', 'South Africa', 'New Zealand', 'West Indies', 'Sri Lanka']"
PEOPLE = f"""SELECT person_id, 'Player ' || SUBSTR(person_id, 2) AS name, n, list_extract({TEAM_LIST}, CAST(n % 8 + 1 AS INT)) AS country,
 list_extract(['Batter', 'Bowler', 'Batting all-rounder', 'Wicketkeeper batter'], CAST(n % 4 + 1 AS INT)) AS role,
 CASE WHEN n % 7 = 0 THEN 'female' ELSE 'male' END AS gender FROM (SELECT DISTINCT person_id, CAST(SUBSTR(person_id, 2) AS INT) AS n FROM nmx)"""


def people_table(t):
    n = F.substring("person_id", 2, 2).cast("int")
    return t.people.withColumns({
        "full_name": F.concat("name", F.when(n % 10 == 3, " 100%_Smith").otherwise("")),
        "gender": F.when(n % 7 == 0, "female").otherwise("male"),
        "team_ids": F.array(text.team_id(F.col("country"), F.lit("male")))})


LIST = ("person_id", "name", "role", "matches", "runs", "balls", "wickets", "bat_avg", "bat_sr",
        "bowl_avg", "econ")
JOINED = {"tot": TOTALS, "ppl": PEOPLE,
          "rows": f"SELECT p.name, p.role, p.gender, p.country, p.n, r.* FROM (SELECT *, {TOTAL_RATES} FROM tot) r JOIN ppl p USING (person_id)"}


@query(sql(f"SELECT {', '.join(LIST)} FROM rows ORDER BY runs DESC NULLS LAST, name, person_id LIMIT 20", "car", mixed=True, extra=JOINED))
def players_by_runs(t):
    return read.list_players(careers_table(t), people_table(t), "runs", size=20).select(*LIST)


@query(sql(f"SELECT {', '.join(LIST)} FROM rows WHERE balls >= 600 AND gender = 'male' ORDER BY bat_avg DESC NULLS LAST, name, person_id LIMIT 10 OFFSET 10",
           "car", mixed=True, extra=JOINED | {"tot": TOTALS.replace("GROUP BY", "WHERE format_key LIKE '%-m' GROUP BY")}))
def players_by_average(t):
    """The second page of a gated rate order."""
    return read.list_players(careers_table(t), people_table(t), "bat_avg", number=2, size=10,
                             gender="male").select(*LIST)


@query(sql(f"SELECT {', '.join(LIST)} FROM rows WHERE LOWER(role) LIKE '%batter' AND LOWER(role) NOT LIKE 'wicketkeeper%' AND country = 'India'",
           "car", mixed=True, extra=JOINED))
def players_filtered(t):
    return read.player_listing(careers_table(t), people_table(t), role="batter", team="india-m").select(*LIST)


@query(sql(f"SELECT {', '.join(LIST)} FROM rows WHERE n % 10 = 3", "car", mixed=True, extra=JOINED))
def players_searched(t):
    """A search for text with wildcard characters finds only that text."""
    return read.player_listing(careers_table(t), people_table(t), search="100%_sm").select(*LIST)


@query(sql("SELECT COUNT(*) AS total FROM rows WHERE bowl_balls >= 900", "car", mixed=True, extra=JOINED))
def players_counted(t):
    return read.player_listing(careers_table(t), people_table(t), "econ").agg(
        F.count(F.lit(1)).alias("total"))


@query(sql("""SELECT person_id, name, country, c.wickets AS value, c.bowl_innings AS innings, c.bowl_balls AS balls FROM carx c JOIN ppl USING (person_id)
WHERE format_key = 't20i-m' AND c.wickets IS NOT NULL ORDER BY c.wickets DESC, name, person_id LIMIT 10""", "car", mixed=True, extra={"ppl": PEOPLE}))
def wicket_leaders(t):
    return read.leaders(careers_table(t), people_table(t), "t20i-m", "wickets", 10)


@query(sql("""SELECT person_id, format_key FROM (SELECT person_id, format_key, ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY
 CASE WHEN format_key LIKE 'odi%' THEN 1 ELSE 0 END DESC, COALESCE(balls, 0) + COALESCE(bowl_balls, 0) DESC,
 CASE WHEN format_key LIKE 'test%' THEN 0 WHEN format_key LIKE 'odi%' THEN 1 ELSE 2 END, format_key DESC) AS rn FROM carx) WHERE rn = 1""", "car", mixed=True))
def main_formats(t):
    return read.main_formats(careers_table(t), asked="odi")


MATCH = "match_id, format_key, end_date, team1_id, team2_id, winner"


@query(sql(f"SELECT {MATCH} FROM mx WHERE format_key IN ('t20i-m', 't20i-w') ORDER BY end_date DESC, match_id LIMIT 12", "m", mixed=True))
def latest_results(t):
    return read.latest_results(match_rows(t), fmt="t20i").select(*MATCH.split(", "))


@query(sql(f"""SELECT {MATCH} FROM mx WHERE (team1_id = 'india-m' OR team2_id = 'india-m') AND end_date >= '2012-01-01' AND end_date < '2013-01-01'
ORDER BY end_date DESC, match_id LIMIT 50""", "m", mixed=True))
def matches_of_a_year(t):
    return read.list_matches(match_rows(t), team="india-m", year=2012).select(*MATCH.split(", "))


@query(sql("SELECT DISTINCT CAST(SUBSTR(end_date, 1, 4) AS BIGINT) AS year FROM mx WHERE format_key LIKE '%-w'", "m", mixed=True))
def match_years(t):
    return read.match_years(match_rows(t), "female")


@query(sql(f"""SELECT {MATCH} FROM mx WHERE match_id % 3 <> 1 ORDER BY end_date DESC, match_id LIMIT 25""", "m", mixed=True))
def replayable_matches(t):
    rows = materialise(match_rows(t), "matches")
    return read.replayable(rows, rows.where(F.col("match_id") % 3 != 1), limit=25).select(*MATCH.split(", "))


@query(sql(f"SELECT {MATCH} FROM mx WHERE format_key = 't20i-m' AND ((team1_id = 'india-m' AND team2_id = 'pakistan-m') OR (team1_id = 'pakistan-m' AND team2_id = 'india-m'))", "m", mixed=True))
def head_to_head(t):
    return read.head_to_head(match_rows(t), "pakistan-m", "india-m", "t20i-m").select(*MATCH.split(", "))


@query(sql("""SELECT s.person_id, s.format_key, dimension, subject, s.balls, s.runs, s.outs FROM bsx s JOIN (SELECT person_id, format_key FROM (SELECT person_id, format_key, ROW_NUMBER() OVER (
 PARTITION BY person_id ORDER BY COALESCE(balls, 0) + COALESCE(bowl_balls, 0) DESC, CASE WHEN format_key LIKE 'test%' THEN 0 WHEN format_key LIKE 'odi%' THEN 1 ELSE 2 END) AS rn FROM carx) WHERE rn = 1) c
 ON c.person_id = s.person_id AND c.format_key = s.format_key WHERE s.balls >= 60""", "car", mixed=True))
def player_profiles(t):
    """The splits that players' pages show: those of the format each plays most."""
    balls = t.hold(mixed=True, arrivals=True)
    chosen = read.main_formats(careers_table(t))
    splits = players.batting_splits(balls, t.people).where("balls >= 60")
    return read.profile_sections(chosen, {"splits": splits})["splits"].select("person_id", "format_key", "dimension", "subject", "balls", "runs", "outs")


@query(sql(f"SELECT {', '.join(LIST)} FROM rows ORDER BY runs DESC NULLS LAST, name NULLS LAST, person_id LIMIT 20 OFFSET 20", "car", mixed=True, extra=JOINED))
def players_after(t):
    """The second page of players by runs, found from the last row of the first."""
    careers, people = materialise(careers_table(t), "careers"), people_table(t)
    first = read.players_behind(careers, people, size=20).collect()  # one page
    cursor = ranking.cursor_of(first[-1], read.player_keys("runs")) if first else None
    return read.players_behind(careers, people, cursor, size=20).select(*LIST)


@query(sql(f"SELECT {MATCH} FROM mx ORDER BY end_date DESC NULLS LAST, match_id LIMIT 25 OFFSET 50", "m", mixed=True))
def matches_after(t):
    """The third page of matches, newest first, from cursor to cursor."""
    rows, cursor = materialise(match_rows(t), "matches"), None
    for _ in range(2):
        page = read.matches_behind(rows, cursor, 25).collect()  # one page each
        cursor = ranking.cursor_of(page[-1], read.MATCH_KEYS) if page else cursor
    return read.matches_behind(rows, cursor, 25).select(*MATCH.split(", "))


@query(sql(f"SELECT {MATCH} FROM mx WHERE match_id IN (3, 5, 8, 13)", "m", mixed=True))
def looked_up_matches(t):
    """Matches looked up in a table that is written for it."""
    path = scratch_dir(t.spark, "lookup")
    read.write_lookup(match_rows(t).select(*MATCH.split(", ")), path, "match_id")
    return read.look_up(t.spark, path, "match_id", [3, 5, 8, 13])


@query(sql(f"SELECT {MATCH} FROM mx WHERE match_id IN (3, 5, 8)", "m", mixed=True))
def matches_by_id(t):
    return read.by_ids(match_rows(t), "match_id", [3, 5, 8]).select(*MATCH.split(", "))


@query(sql(f"""SELECT o.team_id, first_match, last_match, s.matches, o.format_key, team, won, lost, tied, drawn, no_result, win_pct, o.matches AS format_matches
FROM trx o JOIN (SELECT team_id, MIN(first_date) AS first_match, MAX(last_date) AS last_match, {total('matches')} AS matches FROM trx WHERE facet = 'overall' GROUP BY 1) s
 ON s.team_id = o.team_id WHERE facet = 'overall'""", "tr", mixed=True))
def team_listing(t):
    return read.list_teams(teams.records(match_rows(t)))


@query(sql("""SELECT team_id, format_key, facet, subject, 'won ' || won || ' of ' || matches || CASE WHEN won + lost + tied + drawn >= 5
 THEN ' (' || PRINTF('%.1f', win_pct) || '%)' ELSE '' END AS record_text FROM tr""", "tr"))
def record_sentences(t):
    return read.record_text(teams.records(match_rows(t, False))).select(
        "team_id", "format_key", "facet", "subject", "record_text")


PHASES = f"""SELECT LOWER(REPLACE(team, ' ', '-')) || '-m' AS team_id, format_key, side, phase, COUNT(DISTINCT match_id * 10 + innings) AS innings,
 COUNT(CASE WHEN is_legal THEN 1 END) AS balls, {total('runs_total')} AS runs, {total('team_wickets')} AS wickets FROM (
 SELECT *, batting_team AS team, 'batting' AS side FROM d UNION ALL SELECT *, bowling_team, 'bowling' FROM d) GROUP BY 1, 2, 3, 4"""
REC = "'won ' || won || ' of ' || matches || CASE WHEN won + lost + tied + drawn >= 5 THEN ' (' || PRINTF('%.1f', win_pct) || '%)' ELSE '' END"
WORD = "matches || CASE WHEN matches = 1 THEN ' match' ELSE ' matches' END"


@query(sql(f"""SELECT r.team_id, r.subject AS opponent_id, r.format_key, 'Head to head' AS heading, team || ' ' || {REC} || ' against ' || o.opp || '; lost ' || lost || ', tied ' || tied
  || ', drawn ' || drawn || ', no result ' || no_result AS line, {WORD} || ', last on ' || last_date AS sample
 FROM tr r JOIN (SELECT team_id AS subject, MAX(team) AS opp FROM tr GROUP BY 1) o USING (subject) WHERE facet = 'opponent'
UNION ALL SELECT p.team_id, p.subject, p.format_key, 'Batting first or chasing', team || CASE WHEN o.subject = 'batting_first' THEN ' batting first: ' ELSE ' chasing: ' END || rec, sample
 FROM (SELECT team_id, subject, format_key FROM tr WHERE facet = 'opponent') p JOIN (SELECT team_id, format_key, team, subject, {REC} AS rec, {WORD} AS sample FROM tr WHERE facet = 'order') o
  ON o.team_id IN (p.team_id, p.subject) AND o.format_key = p.format_key
UNION ALL SELECT p.team_id, p.subject, p.format_key, 'Opponent ' || side || ', by phase', phase || CASE WHEN side = 'batting' THEN ': scores ' ELSE ': concedes ' END
  || PRINTF('%.2f', CAST(6 AS DOUBLE) * runs / balls) || ' runs per over' || CASE WHEN wickets > 0 THEN ', a wicket every ' || PRINTF('%.1f', balls / wickets) || ' balls' ELSE '' END,
  innings || ' innings, ' || balls || CASE WHEN balls = 1 THEN ' ball' ELSE ' balls' END
 FROM (SELECT team_id, subject, format_key FROM tr WHERE facet = 'opponent') p JOIN ph ON ph.team_id = p.subject AND ph.format_key = p.format_key WHERE balls > 0""",
           "tr", extra={"ph": PHASES}))
def fixture_plans(t):
    """Plans for every pairing: head to head, batting order, opponent's phases."""
    records = materialise(teams.records(match_rows(t, False)), "records")
    labels = records.where("facet = 'overall'").select("team_id", F.col("team").alias("label"))
    return read.fixture_plan(records, teams.phases(t.deliveries), labels)


@query(sql(f"""SELECT team_id, person_id, tb.rank, runs, dimension_key, subject, weakness_no FROM (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY team_id ORDER BY runs DESC, balls, person_id) AS rank
  FROM (SELECT LOWER(REPLACE(team, ' ', '-')) || '-m' AS team_id, person_id, {total('runs')} AS runs, {total('balls')} AS balls FROM bi GROUP BY 1, 2)) WHERE rank <= 6) tb
LEFT JOIN (SELECT person_id, dimension_key, subject, ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY rank) AS weakness_no FROM cl WHERE kind = 'weakness' QUALIFY weakness_no <= 2) USING (person_id)""",
           "bi", extra={"cl": claims_sql("batting")}))
def opponent_threats(t):
    """Each team's leading batters with their own top weaknesses."""
    top = teams.top_batters(state.batting_innings(t.deliveries), teams.gender_of_key(F.col("format_key")))
    claims = cohort.claims(judged(t, "batting"))
    return read.opponent_threats(top, claims, "batting").select(
        "team_id", "person_id", "rank", "runs", "dimension_key", "subject", "weakness_no")


@query(sql("""SELECT axis, a.percentile AS a, b.percentile AS b, CASE WHEN a.percentile > b.percentile THEN 'a' WHEN b.percentile > a.percentile THEN 'b' END AS better
FROM pr a JOIN pr b USING (axis) WHERE a.person_id = 'p03' AND b.person_id = 'p10'""", extra={"pr": profile_sql("batting")}))
def compared_profiles(t):
    """Two players on the profile axes both have."""
    from overstats.catalog.players import bat_splits, batted
    splits = materialise(bat_splits(t), "splits")
    overall = players.batting_overall(batted(t), players.whole(splits))
    profiles = cohort.profiles(splits, overall, "batting")
    return read.compare("p03", "p10", careers_table(t, False), profiles, "t20i-m")[1]


@query(sql("""SELECT match_id, CASE WHEN fmt = 'test' THEN 'Win probability is modelled only for ODIs and T20Is. Tests can be drawn, so a two-outcome model does not fit them.'
 WHEN method = 'D/L' THEN 'This match was decided by the D/L method after rain, so its target does not mean what the model assumes. ' || hid
 WHEN method = 'Awarded' THEN 'This match was awarded rather than played to a finish. ' || hid
 WHEN match_id % 21 = 2 AND fmt <> 'odi' THEN 'This match was shortened to 18 overs a side. The model covers only full 20-over matches. ' || hid
 WHEN match_id % 21 = 2 THEN 'This match was shortened to 18 overs a side. The model covers only full 50-over matches. ' || hid
 WHEN result_type = 'noResult' THEN 'This match had no result, and the model only describes matches that reach one. ' || hid
 WHEN format_key <> 't20i-m' THEN 'No win-probability model is available for ' || format_key || '.' END AS reason
FROM (SELECT *, 'Win probability, projected score and par are hidden.' AS hid FROM mx)""", "m", mixed=True))
def model_eligibility(t):
    rows = match_rows(t).withColumns({
        "scheduled_overs": F.when(F.col("match_id") % 21 == 2, 18).otherwise(F.col("scheduled_overs")),
        "target_overs": F.lit(None).cast("double")})
    return read.eligibility(given_model(t), rows).select("match_id", "reason")


@query(sql("""SELECT match_id, CASE WHEN match_id % 2 = 0 THEN NULL ELSE method END AS method,
 CASE WHEN match_id % 2 = 0 THEN 17 ELSE scheduled_overs END AS scheduled_overs, format_key FROM mx""", "m", mixed=True).replace(
     "THEN 17 ELSE scheduled_overs", "THEN CAST(17 AS BIGINT) ELSE CAST(scheduled_overs AS BIGINT)"))
def replay_facts(t):
    """Replays of the old schema take missing facts from the match row."""
    m = F.col("match_id")
    replays = t.headers(True).select(
        "match_id", "gender", "venue_key", F.lit(None).cast("string").alias("format_key"),
        F.when(m % 2 == 0, 2).otherwise(1).alias("schema_version"),
        F.when(m % 2 == 0, 17).alias("scheduled_overs"), F.lit(None).cast("string").alias("method"))
    return read.with_match_facts(replays, match_rows(t)).select(
        "match_id", "method", "scheduled_overs", "format_key")


CONTEXT = {
    "mp": "SELECT DISTINCT match_id, person_id, batting_team AS team FROM (SELECT match_id, batter_id AS person_id, batting_team FROM d)",
    "fc": "SELECT DISTINCT match_id, bowler_id, bowling_type, bowling_team AS team FROM d",
    "ag": "SELECT mp.match_id, mp.person_id, fc.bowler_id, fc.bowling_type FROM mp JOIN fc ON mp.match_id = fc.match_id AND mp.team <> fc.team",
    "wanted": """SELECT DISTINCT match_id, person_id, 'type' AS dimension, bowling_type AS subject FROM ag WHERE bowling_type <> ''
      UNION SELECT DISTINCT match_id, person_id, 'vs_bowler', bowler_id FROM ag""",
}


@query(sql("""SELECT w.match_id, w.person_id, s.dimension, s.subject, s.balls, s.runs, s.outs FROM wanted w JOIN bs s ON s.person_id = w.person_id AND s.dimension = w.dimension AND s.subject = w.subject WHERE s.balls >= 60
UNION ALL SELECT w.match_id, w.person_id, s.dimension, s.subject, s.balls, s.runs, s.outs FROM (SELECT * FROM wanted WHERE dimension = 'type') w
 JOIN bs s ON s.person_id = w.person_id AND s.dimension = 'type_phase' AND SPLIT_PART(s.subject, '|', 1) = w.subject WHERE s.balls >= 60""", "bs", extra=CONTEXT))
def replay_context(t):
    """Splits of everyone in a match against the types and bowlers they face."""
    from overstats.catalog.players import bat_splits
    splits = materialise(bat_splits(t).where("dimension = 'all' OR balls >= 60"), "splits")
    there = t.deliveries.select(
        "match_id", F.col("batter_id").alias("person_id"), "format_key",
        F.col("batting_team").alias("team")).distinct()
    # Styles are told of a match's bowlers, not of every ball.
    bowled = t.deliveries.select("match_id", "bowler_id", F.lit("").alias("batter_id"), F.col("bowling_team").alias("team")).distinct()
    faced = players.with_people(bowled, t.people).select("match_id", "bowler_id", "bowling_type", "team")
    claims = cohort.claims(cohort.judged_splits(splits, "batting"))
    return read.replay_context(there, claims, splits.where("balls >= 60"), faced)["splits"].drop("format_key")


@query(sql(f"""SELECT match_id, person_id, format_key, kind, rank, dimension_key, subject FROM mp JOIN ({claims_sql("batting")}) cl USING (person_id) WHERE rank <= 2""", "d", extra={"mp": CONTEXT["mp"]}))
def replay_traits(t):
    """The two first strengths and weaknesses of everyone who batted in a match."""
    there = t.deliveries.select(
        "match_id", F.col("batter_id").alias("person_id"), "format_key", F.col("batting_team").alias("team")).distinct()
    nobody = t.deliveries.select("match_id", "bowler_id", F.lit("").alias("bowling_type"), F.col("bowling_team").alias("team")).distinct()
    return read.replay_context(there, cohort.claims(judged(t, "batting")), players.batting_splits(t.deliveries, t.people), nobody)["traits"]


MEASURES = ("matches", "bat_innings", "runs", "bat_avg", "bat_sr", "hundreds", "fifties", "bowl_balls", "wickets", "bowl_avg", "bowl_econ", "bowl_sr")
LONG = ", ".join(f"{{'measure': '{m}', 'value': CAST({m} AS DOUBLE)}}" for m in MEASURES)


@query(sql(f"""SELECT measure, a, b, CASE WHEN measure IN ('bowl_avg', 'bowl_econ', 'bowl_sr') THEN CASE WHEN a < b THEN 'a' WHEN b < a THEN 'b' END WHEN a > b THEN 'a' WHEN b > a THEN 'b' END AS better
FROM (SELECT x.measure AS measure, MAX(CASE WHEN person_id = 'p03' THEN x.value END) AS a, MAX(CASE WHEN person_id = 'p10' THEN x.value END) AS b
 FROM (SELECT person_id, UNNEST([{LONG}]) AS x FROM car WHERE person_id IN ('p03', 'p10') AND format_key = 't20i-m') GROUP BY 1)""", "car"))
def compared_measures(t):
    """Two players' records in one format, and whose is better."""
    none = t.spark.createDataFrame([], "person_id string, format_key string, axis string, percentile double")
    return read.compare("p03", "p10", careers_table(t, False), none, "t20i-m")[0]


@query(sql(f"""SELECT {MATCH} FROM (SELECT * FROM mx WHERE (team1_id = 'india-m' OR team2_id = 'india-m')
 AND format_key = (SELECT format_key FROM trx WHERE team_id = 'india-m' AND facet = 'overall' ORDER BY matches DESC, format_key LIMIT 1)
 ORDER BY end_date DESC, match_id LIMIT 10)""", "tr", mixed=True))
def team_page_recent(t):
    """The other half of a team's page: its last ten matches in the format it plays most."""
    rows = materialise(match_rows(t), "matches")
    return read.team_page(teams.records(rows), rows, "india-m")["recent"].select(*MATCH.split(", "))


@query(sql(f"""SELECT person_id, discipline, section, place, line, balls FROM (
 SELECT person_id, 'batting' AS discipline, CASE WHEN kind = 'weakness' THEN 'attack' ELSE 'avoid' END AS section, rank AS place, dimension_key || '.' || subject AS line, balls FROM cl
 UNION ALL SELECT person_id, 'batting', dimension, ROW_NUMBER() OVER (PARTITION BY person_id, dimension ORDER BY balls DESC, subject), subject, balls FROM bs WHERE dimension IN ('type', 'phase') AND balls >= 60)""",
           "bs", extra={"cl": claims_sql("batting")}))
def dossiers(t):
    """Scouting lines: what to attack, what to avoid, types and phases."""
    from overstats.catalog.players import bat_splits
    splits = materialise(bat_splits(t), "splits").where("balls >= 60").withColumn("discipline", F.lit("batting"))
    claims = cohort.claims(judged(t, "batting"))
    chosen = splits.select("person_id", "format_key").distinct()
    return read.dossier(claims, splits, chosen).select(
        "person_id", "discipline", "section", "place", "line", "balls")


@query(sql(f"SELECT subject, facet, {RECORD} FROM trx WHERE team_id = 'india-m' AND format_key = (SELECT format_key FROM trx WHERE team_id = 'india-m' AND facet = 'overall' ORDER BY matches DESC, format_key LIMIT 1)", "tr", mixed=True))
def team_page(t):
    rows = materialise(match_rows(t), "matches")
    return read.team_page(teams.records(rows), rows, "india-m")["facets"].select(
        "subject", "facet", *RECORD.split(", "))
