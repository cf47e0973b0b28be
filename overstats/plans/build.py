"""The whole build: documents in, published tables out.

Deliveries are flattened once, written, and every statistic reads that
table; each output is a table of its own, published by content so that a
rebuild of the same input changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overstats import config as C
from overstats.operators import cohort, contract, matches, players, publish, quality, state, teams, venues
from overstats.operators import winmodel
from overstats.session import materialise
from overstats.sources import documents as docs
from overstats.sources import sinks

KEYS = {
    "matches": ["match_id"], "batting_innings": ["match_id", "innings", "person_id"],
    "bowling_innings": ["match_id", "innings", "person_id"],
    "batting_splits": ["person_id", "format_key", "dimension", "subject"],
    "bowling_splits": ["person_id", "format_key", "dimension", "subject"],
    "careers": ["person_id", "format_key"], "yearly": ["person_id", "format_key", "year"],
    "dismissals": ["person_id", "format_key", "discipline", "kind", "subject"],
    "names": ["person_id"], "claims": ["person_id", "format_key", "kind", "rank"],
    "profiles": ["person_id", "format_key", "discipline", "axis"],
    "cohorts": ["format_key", "discipline", "metric"],
    "team_records": ["team_id", "format_key", "facet", "subject"],
    "team_phases": ["team_id", "format_key", "side", "phase"],
    "team_batters": ["team_id", "format_key", "rank"],
    "team_bowlers": ["team_id", "format_key", "rank"],
    "venues": ["venue_key", "format_key"], "replays": ["match_id"],
    "summary": ["format_key"],
    "player_documents": ["person_id", "format_key"], "player_index": ["person_id"],
}


@dataclass
class Build:
    """The tables of one build, lazily planned."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    deliveries: DataFrame | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def located(documents: DataFrame, places: DataFrame) -> DataFrame:
    """Documents with the key and country of their ground."""
    rows = documents.withColumns(
        {"venue": F.coalesce("info.venue", F.lit("")), "city": F.coalesce("info.city", F.lit("")),
         "country": F.lit("")})
    grounds = materialise(venues.ground_cities(rows), "grounds")
    keyed = venues.with_venue_key(rows, grounds)
    return venues.with_match_country(keyed, grounds, places).drop("venue", "city", "ground")


def plan(documents: DataFrame, places: DataFrame, people: DataFrame,
         gates: C.Thresholds = C.THRESHOLDS) -> Build:
    """Plan every table of a build over match documents."""
    placed = materialise(located(documents, places), "documents")
    balls = materialise(docs.flatten(placed), "deliveries")
    squads = docs.squads(placed)
    facts = docs.innings_facts(placed)
    totals = matches.innings_totals(balls, facts)
    head = docs.headers(placed).join(
        placed.select("match_id", "venue_key", "country"), "match_id")
    rows = matches.match_rows(head, totals)
    ranks = matches.featured_ranks(rows.drop("innings")).select("match_id", "featured_rank")
    rows = materialise(rows.join(ranks, "match_id", "left"), "matches")

    bat_log = materialise(state.batting_innings(balls), "batting-innings")
    bowl_log = materialise(state.bowling_innings(balls), "bowling-innings")
    bat_cuts = materialise(players.batting_splits(balls, people), "batting-splits")
    bowl_cuts = materialise(players.bowling_splits(balls, people), "bowling-splits")
    bat = materialise(players.batting_overall(bat_log, players.whole(bat_cuts)), "batting-overall")
    bowl = materialise(players.bowling_overall(bowl_log, players.whole(bowl_cuts)), "bowling-overall")
    latest = players.latest_names(
        docs.registry(placed).join(
            squads.select("match_id", "person_id").distinct(), ["match_id", "person_id"]))

    judged = cohort.judged_splits(bat_cuts, "batting", gates).unionByName(
        cohort.judged_splits(bowl_cuts, "bowling", gates))
    claims = cohort.claim_text(cohort.claims(judged, gates))
    profiles = cohort.profiles(bat_cuts, bat, "batting", gates).unionByName(
        cohort.profiles(bowl_cuts, bowl, "bowling", gates))
    cohorts = cohort.reference_quantiles(bat, "batting", gates).unionByName(
        cohort.reference_quantiles(bowl, "bowling", gates))
    careers = players.careers(
        squads, bat, players.batting_milestones(bat_log), bowl,
        players.bowling_milestones(bowl_log), gates)

    shown_bat = sinks.published_splits(
        bat_cuts, gates.bat_split, "vs_bowler",
        players.head_to_heads(bat_cuts, "vs_bowler", gates.bat_split))
    shown_bowl = sinks.published_splits(
        bowl_cuts, gates.bowl_split, "vs_batter",
        players.head_to_heads(bowl_cuts, "vs_batter", gates.bowl_split))
    gender = teams.gender_of_key(F.col("format_key"))
    seen = squads.select("person_id", "format_key").distinct()
    tables = {
        "matches": rows, "batting_innings": bat_log, "bowling_innings": bowl_log,
        "batting_splits": shown_bat, "bowling_splits": shown_bowl, "careers": careers,
        "yearly": players.yearly(bat_cuts, bowl_cuts, bat_log, bowl_log),
        "dismissals": players.dismissal_counts(bat_log, balls, people),
        "names": players.display_names(latest), "claims": claims, "profiles": profiles,
        "cohorts": cohorts, "team_records": teams.records(rows),
        "team_phases": teams.phases(balls), "team_batters": teams.top_batters(bat_log, gender),
        "team_bowlers": teams.top_bowlers(bowl_log, gender), "venues": venues.venue_stats(rows),
        "replays": sinks.replay_documents(balls, rows, people),
        "summary": matches.format_summary(balls, seen),
    }
    tables["player_documents"] = sinks.player_documents(tables["names"], careers, shown_bat, shown_bowl, claims, profiles)
    tables["player_index"] = sinks.player_index(tables["player_documents"])
    return Build(tables, balls)


def write(spark: SparkSession, build: Build, root: str, scope_keys: list[str] | None = None
          ) -> dict[str, DataFrame]:
    """Publish every table, optionally only some format keys; returns the changes.

    A partial build knows only some rows of a table without format key: there
    it adds and replaces, and whatever it doesn't have stays.
    """
    out = {}
    for name, df in build.tables.items():
        keyed = "format_key" in df.columns
        scope = F.col("format_key").isin(*scope_keys) if scope_keys is not None and keyed else None
        out[name] = publish.publish(spark, f"{root}/{name}", df, KEYS[name], scope, deletes=scope_keys is None or keyed)
    return out


def violations(build: Build) -> DataFrame:
    """(table, key, rule) of everything in a build that breaks the tables' contract."""
    return contract.check(build.tables)


def models(build: Build, holdout: str = C.HOLDOUT_FROM,
           min_matches: int = C.MIN_MODEL_MATCHES) -> dict[str, DataFrame]:
    """Win models of a build with ground pars."""
    totals = build["matches"].select("match_id", F.inline("innings"))
    usable = winmodel.usable_matches(
        build["matches"].drop("innings"), totals.select("match_id", "innings", "target_overs"))
    states = materialise(winmodel.traces(build.deliveries, usable), "traces")
    built = winmodel.build_models(states, holdout, min_matches)
    built["venue_pars"] = winmodel.venue_pars(
        build["matches"], built["models"].select("format_key", "par"))
    built["golden"] = winmodel.golden_states(built["models"])
    return built


def verify(build: Build, replays: DataFrame) -> dict[str, DataFrame]:
    """Replays against the rest of the build, with what was checked."""
    # Only what a replay stores is used: flags are worked out again from it.
    from overstats.functions import flags

    balls = flags.with_flags(sinks.explode_replays(replays).withColumns({
        "runs_total": F.col("runs_batter") + F.col("runs_extras"),
        "bowling_team": F.lit(""), "date": F.lit(""), "venue": F.lit(""), "country": F.lit(""),
        "bowler": F.col("bowler_id"), "penalty": F.col("penalty")}))
    totals = matches.innings_totals(balls).select(
        "match_id", "innings", "team", "runs", "wickets", "balls",
        F.lit(0).alias("penalty_runs"))
    want = build["matches"].select("match_id", F.inline("innings")).select(
        "match_id", "innings", "team", (F.col("runs") - F.col("penalty_runs")).alias("runs"),
        "wickets", "balls", F.lit(0).alias("penalty_runs")).where("balls > 0 OR runs > 0")
    bowling = state.bowling_innings(balls)
    return {
        "innings": quality.reconcile_innings(totals, want),
        "bowling": quality.reconcile_bowling(bowling, build["bowling_innings"]),
        "extras": quality.extras_mismatches(balls),
        "missing": publish.missing_replays(build["matches"], replays),
    }
