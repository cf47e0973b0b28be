"""Queries over matches, teams and grounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from overstats.catalog.base import n_if, query, ratio, sql, total
from overstats.functions import geography, text
from overstats.operators import matches as ops
from overstats.operators import players, state, teams, venues
from overstats.sources import documents as docs
from overstats.sources.tables import GROUNDS


def match_rows(t, mixed=True):
    rows = t.mixed if mixed else t.deliveries
    return ops.match_rows(t.headers(mixed), ops.innings_totals(rows))


RECORD = "matches, won, lost, tied, drawn, no_result"


@query(sql("""SELECT match_id, innings, team, runs, wickets, balls,
 CAST(balls // 6 AS VARCHAR) || '.' || CAST(balls % 6 AS VARCHAR) AS overs, target AS target_runs FROM itx""", "it", mixed=True))
def innings_totals(t):
    return ops.innings_totals(t.mixed).select(
        "match_id", "innings", "team", "runs", "wickets", "balls", "overs", "target_runs")


RESULT_TEXT = """CASE WHEN tied THEN 'Match tied (' || team1 || ' won the Super Over)' WHEN drawn THEN 'Match drawn'
 WHEN winner IS NULL THEN 'No result'
 WHEN margin_innings AND COALESCE(margin_runs, 0) <> 0 THEN winner || ' won by an innings and ' || margin_runs || CASE WHEN margin_runs = 1 THEN ' run' ELSE ' runs' END
 WHEN margin_innings THEN winner || ' won by an innings'
 WHEN margin_runs IS NOT NULL THEN winner || ' won by ' || margin_runs || CASE WHEN margin_runs = 1 THEN ' run' ELSE ' runs' END
 WHEN margin_wickets IS NOT NULL THEN winner || ' won by ' || margin_wickets || CASE WHEN margin_wickets = 1 THEN ' wicket' ELSE ' wickets' END
 WHEN method = 'Awarded' THEN winner || ' won (awarded)' ELSE winner || ' won' END
 || CASE WHEN method = 'D/L' THEN ' (D/L method)' ELSE '' END"""


@query(sql(f"""SELECT match_id, format_key, start_date, end_date, venue_key, team1_id, team2_id, toss_winner, toss_decision,
 result_type, winner, CAST(margin_runs AS BIGINT) AS margin_runs, CAST(margin_wickets AS BIGINT) AS margin_wickets, margin_innings,
 method, eliminator, {RESULT_TEXT} AS result_text, batting_first, first_innings_total FROM mx""", "m", mixed=True))
def match_results(t):
    return match_rows(t).select(
        "match_id", "format_key", "start_date", "end_date", "venue_key", "team1_id", "team2_id",
        "toss_winner", "toss_decision", "result_type", "winner", "margin_runs", "margin_wickets",
        "margin_innings", "method", "eliminator", "result_text", "batting_first",
        "first_innings_total")


@query(sql(f"""SELECT team_id, format_key, facet, subject, team, {RECORD}, first_date, last_date, last_match_id,
 first_innings, first_innings_runs, win_pct FROM trx""", "tr", mixed=True))
def team_records(t):
    return teams.records(match_rows(t))


@query(sql(f"""SELECT team_id, format_key, side, phase, innings, balls, runs, wickets, dots, fours, sixes,
 {ratio('runs', 'balls', 6)} AS runs_per_over, {ratio('balls', 'wickets')} AS balls_per_wicket,
 {ratio('dots', 'balls', 100)} AS dot_pct, {ratio('fours + sixes', 'balls', 100)} AS boundary_pct
FROM (SELECT LOWER(REPLACE(team, ' ', '-')) || CASE WHEN format_key LIKE '%-w' THEN '-w' ELSE '-m' END AS team_id, format_key, side, phase,
 COUNT(DISTINCT match_id * 10 + innings) AS innings, {n_if('is_legal')} AS balls, {total('runs_total')} AS runs, {total('team_wickets')} AS wickets,
 {n_if('is_bowler_dot')} AS dots, {n_if('runs_batter = 4')} AS fours, {n_if('runs_batter = 6')} AS sixes FROM (
 SELECT *, batting_team AS team, 'batting' AS side FROM dx UNION ALL SELECT *, bowling_team, 'bowling' FROM dx) GROUP BY 1, 2, 3, 4)""",
           "d", mixed=True))
def team_phases(t):
    return teams.phases(t.mixed)


TEAM_OF = "LOWER(REPLACE(team, ' ', '-')) || CASE WHEN format_key LIKE '%-w' THEN '-w' ELSE '-m' END"


@query(sql(f"""SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY team_id, format_key ORDER BY runs DESC, balls, person_id) AS rank FROM (
 SELECT {TEAM_OF} AS team_id, format_key, person_id, COUNT(*) AS innings, {total('runs')} AS runs, {total('balls')} AS balls,
 {n_if('out')} AS outs, {n_if('runs >= 100')} AS hundreds, {n_if('runs >= 50 AND runs < 100')} AS fifties, MAX(runs) AS highest
 FROM bix GROUP BY 1, 2, 3)) WHERE rank <= 15""", "bi", mixed=True))
def team_top_batters(t):
    return teams.top_batters(state.batting_innings(t.mixed), teams.gender_of_key(F.col("format_key")))


@query(sql(f"""SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY team_id, format_key ORDER BY wickets DESC, runs_conceded, person_id) AS rank FROM (
 SELECT {TEAM_OF} AS team_id, format_key, person_id, COUNT(*) AS innings, {total('balls')} AS balls, {total('runs')} AS runs_conceded,
 {total('wickets')} AS wickets, {n_if('wickets >= 5')} AS five_wickets FROM wix GROUP BY 1, 2, 3)) WHERE rank <= 15""", "wi", mixed=True))
def team_top_bowlers(t):
    return teams.top_bowlers(state.bowling_innings(t.mixed), teams.gender_of_key(F.col("format_key")))


@query(sql(f"""SELECT team_id, format_key, subject, {RECORD}, first_innings, rank,
 {ratio('first_innings_runs', 'first_innings')} AS first_innings_avg FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY team_id, format_key ORDER BY matches DESC, subject) AS rank FROM trx WHERE facet = 'venue') WHERE rank <= 40""",
           "tr", mixed=True))
def team_venues(t):
    return teams.top_venues(teams.records(match_rows(t))).select(
        "team_id", "format_key", "subject", *RECORD.split(", "), "first_innings", "rank",
        "first_innings_avg")


@query(sql("""SELECT team_id, format_key, match_id, end_date, outcome, rank FROM (SELECT *, ROW_NUMBER() OVER (
 PARTITION BY team_id, format_key ORDER BY end_date DESC, match_id DESC) AS rank FROM sidex) WHERE rank <= 10""", "side", mixed=True))
def team_recent_matches(t):
    return teams.recent_matches(match_rows(t))


@query(sql(f"""SELECT team_id, MAX(team) AS team, MIN(first_date) AS first_match, MAX(last_date) AS last_match, {total('matches')} AS matches
FROM trx WHERE facet = 'overall' GROUP BY 1""", "tr", mixed=True))
def teams_across_formats(t):
    return teams.across_formats(teams.records(match_rows(t)))


@query(sql("""SELECT team_id, format_key, facet, subject, won + lost + tied + drawn AS decided,
 CASE WHEN won + lost + tied + drawn >= 5 THEN win_pct END AS shown_win_pct FROM trx""", "tr", mixed=True))
def gated_win_percentages(t):
    return teams.gated_win_pct(teams.records(match_rows(t))).select(
        "team_id", "format_key", "facet", "subject", "decided", "shown_win_pct")


@query(sql(f"""SELECT team_id, format_key, matches, decided, toss_won, toss_lost, decisions, decided_won,
 CASE WHEN decided_won >= 5 THEN won_pct END AS won_toss_pct,
 CASE WHEN toss_won + toss_lost = matches AND decisions = toss_won AND decided - decided_won >= 5 THEN lost_pct END AS lost_toss_pct
FROM (SELECT team_id, format_key, {total("CASE WHEN facet = 'overall' THEN matches END")} AS matches,
 {total("CASE WHEN facet = 'overall' THEN won + lost + tied + drawn END")} AS decided,
 {total("CASE WHEN facet = 'toss' AND subject = 'won' THEN matches END")} AS toss_won,
 {total("CASE WHEN facet = 'toss' AND subject = 'lost' THEN matches END")} AS toss_lost,
 {total("CASE WHEN facet = 'decision' THEN matches END")} AS decisions,
 {total("CASE WHEN facet = 'decision' THEN won + lost + tied + drawn END")} AS decided_won,
 MAX(CASE WHEN facet = 'toss' AND subject = 'won' THEN win_pct END) AS won_pct,
 MAX(CASE WHEN facet = 'toss' AND subject = 'lost' THEN win_pct END) AS lost_pct FROM tr
 WHERE facet IN ('overall', 'toss', 'decision') GROUP BY 1, 2)""", "tr"))
def toss_win_percentages(t):
    return teams.toss_win_pcts(teams.records(match_rows(t, False)))


@query(sql(f"""SELECT venue_key, format_key, COUNT(*) AS matches, {total('all_runs')} AS runs, {total('all_balls')} AS balls,
 {total('all_wickets')} AS wickets, CAST(COUNT(first_innings_total) AS BIGINT) AS first_innings, {total('first_innings_total')} AS first_innings_runs,
 {ratio(total('all_runs'), total('all_balls'), 6)} AS runs_per_over, {ratio(total('all_balls'), total('all_wickets'))} AS balls_per_wicket,
 {ratio(total('first_innings_total'), 'COUNT(first_innings_total)')} AS first_innings_avg FROM mx GROUP BY 1, 2""", "m", mixed=True))
def venue_stats(t):
    return venues.venue_stats(match_rows(t))


ALIAS = """CASE TRIM(city) WHEN 'Bangalore' THEN 'Bengaluru' WHEN 'Barbados' THEN '' ELSE TRIM(city) END"""
GROUND = {
    "g": f"SELECT match_id, venue, city, TRIM(SPLIT_PART(venue, ',', 1)) AS ground, {ALIAS} AS norm FROM mx",
    "amb": "SELECT ground FROM g WHERE norm <> '' GROUP BY 1 HAVING COUNT(DISTINCT norm) > 1",
    "usual": """SELECT ground, norm AS usual FROM (SELECT ground, norm, ROW_NUMBER() OVER (PARTITION BY ground ORDER BY COUNT(*) DESC, norm) AS rn
      FROM g WHERE norm <> '' GROUP BY 1, 2) WHERE rn = 1""",
    "keyed": """SELECT g.*, CASE WHEN g.ground IN (SELECT ground FROM amb) AND norm <> '' THEN g.ground || '|' || norm ELSE g.ground END AS venue_key FROM g""",
}


@query(sql("SELECT match_id, venue, ground, venue_key FROM keyed", "m", mixed=True, extra=GROUND))
def venue_keys(t):
    """Grounds that share a name told apart by city, worked out from the matches."""
    rows = t.headers(True).drop("venue_key")
    return venues.with_venue_key(rows, venues.ground_cities(rows)).select(
        "match_id", "venue", "ground", "venue_key")


def _places(t):
    """A gazetteer derived from the bound grounds: by city, or by ground and city."""
    rules = {}
    for venue, city, key, country in GROUNDS:
        ground = venue.split(",")[0]
        if "|" in key:
            rules[(ground, city)] = country
        elif country and city not in ("Barbados",):
            rules[("", "Bengaluru" if city == "Bangalore" else city)] = country
    rules[("Kensington Oval", "")] = "West Indies"
    return t.spark.createDataFrame([(g, c, x) for (g, c), x in sorted(rules.items())],
                                   "ground string, city string, country string")


@query(sql("""SELECT match_id, venue_key, country FROM mx""", "m", mixed=True))
def match_countries(t):
    rows = t.headers(True).drop("venue_key", "country").withColumn("country", F.lit(None).cast("string"))
    grounds = venues.ground_cities(rows)
    keyed = venues.with_venue_key(rows, grounds)
    return venues.with_match_country(keyed, grounds, _places(t)).select(
        "match_id", "venue_key", "country")


@query(sql("""SELECT venue_key, COALESCE(CASE WHEN CONTAINS(venue_key, '|') THEN SPLIT_PART(venue_key, '|', 2) END,
 CASE WHEN ground NOT IN (SELECT ground FROM amb) THEN usual END, loose, '') AS key_city
FROM (SELECT DISTINCT venue_key, ground FROM keyed) LEFT JOIN usual USING (ground)
LEFT JOIN (SELECT ground, MIN(TRIM(city)) AS loose FROM g WHERE norm = '' AND city <> '' GROUP BY 1) USING (ground)""",
           "m", mixed=True, extra=GROUND))
def venue_cities(t):
    rows = t.headers(True).drop("venue_key")
    grounds = venues.ground_cities(rows)
    return venues.key_cities(venues.with_venue_key(rows, grounds), grounds)


@query(sql("""SELECT venue_key, country FROM (SELECT venue_key, country, ROW_NUMBER() OVER (PARTITION BY venue_key ORDER BY COUNT(*) DESC, country) AS rn
 FROM mx WHERE country <> '' GROUP BY 1, 2) WHERE rn = 1""", "m", mixed=True))
def venue_countries(t):
    return venues.venue_countries(t.headers(True))


@query(sql("""SELECT match_id, team, opponent, country, CASE WHEN country = '' THEN 'unknown' WHEN country = team THEN 'home'
  WHEN country = opponent THEN 'away' ELSE 'neutral' END AS venue_type,
 CASE WHEN country = '' THEN '' WHEN country = team THEN 'home' ELSE 'away' END AS home_flag FROM sidex""", "side", mixed=True))
def home_and_away(t):
    rows = teams.sides(match_rows(t))
    return rows.select(
        "match_id", "team", "opponent", F.coalesce("country", F.lit("")).alias("country"),
        geography.venue_type(F.col("team"), F.col("opponent"), F.col("country")).alias("venue_type"),
        geography.home_flag(F.col("team"), F.col("country")).alias("home_flag"))


@query(sql("""SELECT match_id, start_date, event_name, event_stage, ROW_NUMBER() OVER (ORDER BY pos NULLS LAST, start_date DESC, match_id DESC) AS featured_rank
FROM (SELECT *, CASE match_id WHEN 7 THEN 1 WHEN 3 THEN 2 WHEN 12 THEN 3 END AS pos FROM mx)
WHERE pos IS NOT NULL OR (event_stage = 'Final' AND event_name = 'World Cup')""", "m", mixed=True))
def featured_ranks(t):
    return ops.featured_ranks(t.headers(True), curated=("7", "3", "12")).select(
        "match_id", "start_date", "event_name", "event_stage", "featured_rank")


@query(sql("""SELECT match_id, fmt FROM mx WHERE match_id IN (3, 7)
UNION SELECT match_id, fmt FROM (SELECT m.match_id, m.fmt, ROW_NUMBER() OVER (PARTITION BY m.fmt ORDER BY end_date DESC, m.match_id DESC) AS rn,
  (SELECT COUNT(*) FROM mx h WHERE h.fmt = m.fmt AND h.match_id IN (3, 7)) AS held FROM mx m
 WHERE team1 IN ('India', 'Australia', 'England', 'Pakistan') AND team2 IN ('India', 'Australia', 'England', 'Pakistan')
  AND match_id NOT IN (3, 7) AND match_id NOT IN (SELECT match_id FROM dx WHERE kind2 IS NOT NULL))
WHERE rn <= CASE fmt WHEN 'test' THEN 2 WHEN 'odi' THEN 4 ELSE 5 END - held""", "m", mixed=True))
def sample_selection(t):
    return ops.sample_selection(
        t.headers(True), t.mixed, ["India", "Australia", "England", "Pakistan"],
        {"test": 2, "odi": 4, "t20i": 5}, ["3", "7"])


@query(sql(f"""SELECT format_key, matches, deliveries, venues, first_date, last_date, players FROM (
 SELECT format_key, COUNT(DISTINCT match_id) AS matches, COUNT(*) AS deliveries, COUNT(DISTINCT venue_key) AS venues,
 MIN(date) AS first_date, MAX(date) AS last_date FROM dx GROUP BY 1) JOIN (
 SELECT format_key, COUNT(DISTINCT person_id) AS players FROM nmx GROUP BY 1) USING (format_key)""", "nm", mixed=True))
def format_summary(t):
    people = players.squads_from_deliveries(t.mixed).select("person_id", "format_key").distinct()
    return ops.format_summary(t.mixed, people)


@query(sql(f"""SELECT COALESCE(fmt, 'all') AS fmt, CAST(SUM(CASE WHEN sex = 'm' THEN matches END) AS BIGINT) AS m_matches,
 CAST(SUM(CASE WHEN sex = 'w' THEN matches END) AS BIGINT) AS w_matches, CAST(SUM(CASE WHEN sex = 'm' THEN balls END) AS BIGINT) AS m_deliveries,
 CAST(SUM(CASE WHEN sex = 'w' THEN balls END) AS BIGINT) AS w_deliveries,
 CAST(100 AS DOUBLE) * CAST(SUM(CASE WHEN sex = 'w' THEN matches END) AS BIGINT) / CAST(SUM(CASE WHEN sex = 'm' THEN matches END) AS BIGINT) AS matches_pct,
 CAST(100 AS DOUBLE) * CAST(SUM(CASE WHEN sex = 'w' THEN balls END) AS BIGINT) / CAST(SUM(CASE WHEN sex = 'm' THEN balls END) AS BIGINT) AS deliveries_pct
FROM (SELECT fmt, CASE WHEN gender = 'female' THEN 'w' ELSE 'm' END AS sex, COUNT(DISTINCT match_id) AS matches, COUNT(*) AS balls FROM dx GROUP BY 1, 2)
GROUP BY ROLLUP (fmt)""", "d", mixed=True))
def volume_by_gender(t):
    people = players.squads_from_deliveries(t.mixed).select("person_id", "format_key").distinct()
    return ops.volume_by_gender(ops.format_summary(t.mixed, people))


@query(sql(f"""SELECT pair_low, pair_high, format_key, COUNT(*) AS matches, {n_if('winner = team1')} AS listed_first_won, MAX(end_date) AS last_date
FROM (SELECT *, LEAST(team1_id, team2_id) AS pair_low, GREATEST(team1_id, team2_id) AS pair_high FROM mx) GROUP BY 1, 2, 3""", "m", mixed=True))
def meetings(t):
    """Matches between two teams, whichever is listed first."""
    c = F.col
    return match_rows(t).groupBy(
        F.least("team1_id", "team2_id").alias("pair_low"),
        F.greatest("team1_id", "team2_id").alias("pair_high"), "format_key",
    ).agg(F.count(F.lit(1)).alias("matches"),
          F.count(F.when(c("winner") == c("team1"), 1)).alias("listed_first_won"),
          F.max("end_date").alias("last_date"))


@query(sql("SELECT match_id, match_id % 5 NOT IN (1, 2, 3) AS has FROM dx GROUP BY 1", "d", mixed=True))
def documents_with_deliveries(t):
    """Some documents without innings, with overs that hold nothing, or with super overs alone."""
    m, innings = F.col("match_id") % 5, F.col("innings")
    bare = F.transform(innings, lambda i: i.withField("overs", F.transform(i["overs"], lambda o: o.withField("deliveries", F.slice(o["deliveries"], 1, 0)))))
    extra = F.transform(innings, lambda i: i.withField("super_over", F.lit(True)))
    rows = t.documents(mixed=True).withColumn("innings", F.when(m == 1, F.slice(innings, 1, 0)).when(m == 2, bare).when(m == 3, extra).otherwise(innings))
    return rows.select("match_id", docs.has_deliveries(F.col("innings")).alias("has"))


@query(sql("""SELECT match_id, event_name, event_stage, (event_stage = 'Final' AND event_name = 'World Cup') IS TRUE AS featured FROM mx""", "m", mixed=True))
def featured_finals(t):
    return t.headers(True).select(
        "match_id", "event_name", "event_stage",
        text.is_featured_final(F.col("event_name"), F.col("event_stage")).alias("featured"))
