"""Queries over publishing, guards and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from overstats.catalog.base import n_if, query, sql, total
from overstats.catalog.matches import TEAM_OF, match_rows
from overstats.catalog.players import careers_table
from overstats.functions import text
from overstats.operators import contract
from overstats.operators import matches as match_ops
from overstats.operators import players, publish, quality, ranking, state, teams
from overstats.session import materialise, scratch_dir
from overstats.sources import fingerprint as prints
from overstats.sources import manifests, sinks


def _old(rows):
    """The same table as an earlier build held it: some rows absent, some stale."""
    k = F.col("o_orderkey")
    return rows.where(k % 11 != 3).withColumn(
        "o_custkey", F.when(k % 7 == 2, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))


COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 5 AND o_orderkey % 11 = 3 THEN NULL WHEN o_orderkey % 13 = 5 THEN 'deleted'
 WHEN o_orderkey % 11 = 3 THEN 'inserted' WHEN o_orderkey % 7 = 2 THEN 'updated' ELSE 'unchanged' END AS status FROM orders
WHERE NOT (o_orderkey % 13 = 5 AND o_orderkey % 11 = 3)""")
def change_set(t):
    rows = t.table("orders")
    return publish.change_set(_old(rows), rows.where(F.col("o_orderkey") % 13 != 5), ["o_orderkey"])


@query("""SELECT 'orders' AS "table", status, COUNT(*) AS n FROM (SELECT CASE WHEN o_orderkey % 13 = 5 THEN 'deleted'
 WHEN o_orderkey % 11 = 3 THEN 'inserted' WHEN o_orderkey % 7 = 2 THEN 'updated' ELSE 'unchanged' END AS status FROM orders
WHERE NOT (o_orderkey % 13 = 5 AND o_orderkey % 11 = 3)) GROUP BY 2""")
def change_counts(t):
    rows = t.table("orders")
    return publish.change_counts(publish.change_set(
        _old(rows), rows.where(F.col("o_orderkey") % 13 != 5), ["o_orderkey"]), "orders")


@query("""SELECT * FROM orders WHERE o_orderkey % 13 <> 5""")
def applied_snapshot(t):
    """A table published as an earlier build held it, then as it is now without some rows, and read back."""
    root = f"{scratch_dir(t.spark, 'snapshots')}/orders"
    rows = t.table("orders")
    publish.publish(t.spark, root, _old(rows), ["o_orderkey"], buckets=16)
    publish.publish(t.spark, root, rows.where(F.col("o_orderkey") % 13 != 5), ["o_orderkey"])
    return publish.read_snapshot(t.spark, root)


@query("""SELECT * REPLACE (CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderkey % 7 = 2 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey) FROM orders
 WHERE CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey % 13 <> 5 ELSE o_orderkey % 11 <> 3 END""")
def partial_snapshot(t):
    """The same with a second build that knows one priority alone: rows of the others stay as they were."""
    root = f"{scratch_dir(t.spark, 'snapshots')}/orders"
    rows, urgent = t.table("orders"), F.col("o_orderpriority") == "1-URGENT"
    publish.publish(t.spark, root, _old(rows), ["o_orderkey"], buckets=16)
    publish.publish(t.spark, root, rows.where(F.col("o_orderkey") % 13 != 5), ["o_orderkey"], scope=urgent)
    return publish.read_snapshot(t.spark, root)


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey % 9 = 4 AND o_orderkey % 3 <> 0
UNION ALL SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey % 9 <> 4""")
def regrouped_snapshot(t):
    """Groups that arrive anew replace all rows they had; the rest is neither read nor written."""
    root = f"{scratch_dir(t.spark, 'snapshots')}/orders"
    rows, c = t.table("orders").select("o_custkey", "o_orderkey", "o_totalprice"), F.col
    publish.publish(t.spark, root, rows, ["o_custkey", "o_orderkey"], bucket_by=["o_custkey"], buckets=16)
    again = rows.where((c("o_custkey") % 9 == 4) & (c("o_orderkey") % 3 != 0))
    groups = rows.where(c("o_custkey") % 9 == 4).select("o_custkey")
    publish.publish(t.spark, root, again, ["o_custkey", "o_orderkey"], groups=groups)
    return publish.read_snapshot(t.spark, root)


@query("""SELECT o_orderkey, SHA256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority
 || '","o_orderstatus":' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}') AS hash FROM orders""")
def row_hashes(t):
    rows = t.table("orders").select(*COLS).withColumn(
        "o_orderstatus", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")))
    return rows.select("o_orderkey", publish.row_hash(rows).alias("hash"))


@query("""SELECT o_custkey, BOOL_OR(changed) AS changed FROM (SELECT o_custkey, o_orderkey % 101 = 7 AS changed FROM orders) GROUP BY 1""")
def changed_groups(t):
    """Groups with any changed row, found by comparing one hash per group."""
    rows = t.table("orders")
    stale = rows.withColumn("o_orderpriority", F.when(
        F.col("o_orderkey") % 101 == 7, "was").otherwise(F.col("o_orderpriority")))
    was, now = publish.group_hash(stale, ["o_custkey"]), publish.group_hash(rows, ["o_custkey"])
    return was.withColumnRenamed("hash", "_was").join(now, "o_custkey").select(
        "o_custkey", (F.col("_was") != F.col("hash")).alias("changed"))


@query("""SELECT o_custkey, o_orderkey, size FROM (SELECT o_custkey, o_orderkey, o_orderkey % 50 AS size,
 ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 50 DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def deduplicated(t):
    rows = t.table("orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 50).alias("size"))
    return ranking.dedupe_largest(rows, "o_custkey", "size", "o_orderkey")


@query("""SELECT kind, format_key, before, after FROM (SELECT 'orders' AS kind, o_orderpriority AS format_key, COUNT(*) AS before,
 COUNT(CASE WHEN o_orderkey % 10 <> 3 OR o_orderpriority <> '1-URGENT' THEN 1 END) AS after FROM orders GROUP BY 2) WHERE before > 0 AND after < before * CAST(0.95 AS DOUBLE)""")
def shrink_guard(t):
    c = F.col
    rows = t.table("orders").withColumn("format_key", c("o_orderpriority"))
    now = rows.where((c("o_orderkey") % 10 != 3) | (c("o_orderpriority") != "1-URGENT"))
    return publish.shrink_problems(publish.input_counts({"orders": rows}),
                                   publish.input_counts({"orders": now}))


@query(sql("SELECT match_id FROM mx WHERE match_id % 6 = 1", "m", mixed=True))
def missing_replays(t):
    stored = t.headers(True).where(F.col("match_id") % 6 != 1)
    return publish.missing_replays(t.headers(True), stored)


RUNS = "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CASE WHEN o_orderkey % 40 = 7 THEN 'complete' ELSE 'failed' END AS status, o_orderdate AS finished_at FROM orders"


def _runs(t):
    k = F.col("o_orderkey")
    return t.table("orders").select(
        k.cast("string").alias("run_id"), F.when(k % 40 == 7, "complete").otherwise("failed").alias("status"),
        F.col("o_orderdate").alias("finished_at"))


@query(f"""WITH r AS ({RUNS}) SELECT run_id, status FROM (SELECT * FROM (SELECT * FROM r ORDER BY finished_at DESC, run_id DESC LIMIT 30)
 UNION SELECT * FROM (SELECT * FROM r WHERE status = 'complete' ORDER BY finished_at DESC, run_id DESC LIMIT 1))""")
def retained_runs(t):
    return publish.retained_runs(_runs(t)).select("run_id", "status")


@query(f"WITH r AS ({RUNS}) SELECT run_id FROM r WHERE status = 'complete' ORDER BY finished_at DESC, run_id DESC LIMIT 1")
def active_run(t):
    return publish.active_run(_runs(t)).select("run_id")


@query("""SELECT p_partkey, CASE WHEN fmt IN ('test', 'odi', 't20i') THEN fmt || '-m' ELSE fmt END AS format_key FROM (
 SELECT p_partkey, list_extract(['test', 'odi', 't20i', 'odi-w'], CAST(p_partkey % 4 + 1 AS INT)) AS fmt FROM part)""")
def rekeyed(t):
    from overstats.sources.tables import _pick
    rows = t.table("part").select("p_partkey", _pick(("test", "odi", "t20i", "odi-w"), F.col("p_partkey") % 4).alias("fmt"))
    return publish.rekey_old(rows).select("p_partkey", "format_key")


def _manifests(t):
    """A build for each customer: every third of the first schema version, some without parts, as JSON texts."""
    k = F.col("c_custkey")
    day = F.concat(F.lit("20"), F.lpad((k % 23 + 1).cast("string"), 2, "0"), F.lit("-05-17"))
    text = F.when(k % 3 == 0, F.format_string(
        '{"generated":"%sT10:00:00","playerCount":%d,"formats":{"odi":{"label":"ODI","matches":%d,"players":7,"lastDate":"%s"},"test":null},"thresholds":{"minBallsSplit":%d}}',
        day, k, k % 50, day, k % 9)).otherwise(F.format_string(
            '{"schemaVersion":2,"buildId":"b%d","generated":"%sT10:00:00","fingerprint":"f%d","playerCount":%d,"matchCount":%d,'
            '"formats":{"odi-w":{"formatKey":"odi-w","format":"odi","gender":"female","label":"ODI","matches":%d,"players":%d,"lastDate":"%s"},"bbl-m":{"formatKey":"bbl-m","format":"bbl","gender":"male","label":"BBL","matches":3}},'
            '"thresholds":{"teamMinMatches":%d},"provenance":"live","phases":{"odi":[1,2]}}', k, day, k, k, k * 2, k % 40, k % 30, day, k % 6))
    return t.table("customer").select(
        k.cast("string").alias("run_id"), F.when(k % 40 == 7, "complete").otherwise("failed").alias("status"), (k * 7919 % 10007).alias("finished_at"), text.alias("manifest"))


BUILDS = """SELECT CAST(c_custkey AS VARCHAR) AS run_id, c_custkey AS k, c_custkey % 3 = 0 AS old, '20' || LPAD(CAST(c_custkey % 23 + 1 AS VARCHAR), 2, '0') || '-05-17' AS day,
 CASE WHEN c_custkey % 40 = 7 THEN 'complete' ELSE 'failed' END AS status, c_custkey * 7919 % 10007 AS finished_at FROM customer"""
NORMAL = f"""SELECT run_id, status, finished_at, day, CAST(CASE WHEN old THEN 1 ELSE 2 END AS BIGINT) AS version, CASE WHEN old THEN day || 'T10:00:00-v1' ELSE 'b' || k END AS build_id, day || 'T10:00:00' AS generated,
 CASE WHEN NOT old THEN 'f' || k END AS fingerprint, k AS player_count, CASE WHEN NOT old THEN k * 2 END AS match_count,
 CASE WHEN old THEN 5 ELSE k % 6 END AS team_min, CASE WHEN old THEN CAST(k % 9 AS DOUBLE) END AS split_min, CASE WHEN NOT old THEN '{{"odi":[1,2]}}' END AS phases, CASE WHEN NOT old THEN '"live"' END AS provenance,
 CASE WHEN old THEN 'odi-m odi male ODI ' || (k % 50) || ' 7 ' || day ELSE 'bbl-m bbl male BBL 3 - -,odi-w odi female ODI ' || (k % 40) || ' ' || (k % 30) || ' ' || day END AS formats FROM ({BUILDS})"""
PLAIN = "version, build_id, generated, fingerprint, player_count, match_count, CAST(team_min AS DOUBLE) AS team_min, CAST(3 AS DOUBLE) AS venue_min, split_min, phases, provenance, formats"


def _plain(rows, *names):
    fields = ("format_key", "format", "gender", "label", "matches", "players", "lastDate")
    line = lambda f: F.concat_ws(" ", *[F.coalesce(f[x].cast("string"), F.lit("-")) for x in fields])
    gate = lambda k: F.try_element_at("thresholds", F.lit(k))
    return rows.select(
        *names, "fingerprint", "player_count", "match_count", gate("teamMinMatches").alias("team_min"), gate("venueMinInnings").alias("venue_min"), gate("minBallsSplit").alias("split_min"),
        "phases", "provenance", F.array_join(F.array_sort(F.transform(F.map_values("formats"), line)), ",").alias("formats"))


@query(f"SELECT run_id, {PLAIN} FROM ({NORMAL})")
def normalised_manifests(t):
    """Manifests of two schema versions in one shape."""
    return _plain(manifests.normalised(_manifests(t)), "run_id", "version", "build_id", "generated")


@query(f"""SELECT {PLAIN.replace('version,', 'version AS schema_version,').replace('generated,', 'generated AS generated_at,')}, finished_at AS imported_at, day AS data_as_of FROM ({NORMAL})
 WHERE status = 'complete' ORDER BY finished_at DESC, run_id DESC LIMIT 1""")
def dataset_meta(t):
    """The latest complete run as readers see it."""
    return _plain(manifests.dataset_meta(_manifests(t)), "schema_version", "build_id", "generated_at", "imported_at", "data_as_of")


def _damaged(t):
    m = F.col("match_id")
    return match_rows(t).withColumns({
        "team2": F.when(m % 13 == 0, F.col("team1")).otherwise(F.col("team2")),
        "end_date": F.when(m % 10 == 4, "2009-01-01").otherwise(F.col("end_date")),
        "gender": F.when(m % 8 == 5, "unknown").otherwise(F.col("gender"))})


@query(sql("""SELECT key, rule FROM (SELECT CAST(match_id AS VARCHAR) AS key, UNNEST([CASE WHEN match_id % 13 = 0 THEN 'teams' END,
 CASE WHEN match_id % 10 = 4 THEN 'end_date' END, CASE WHEN match_id % 8 = 5 THEN 'gender' END,
 CASE WHEN match_id % 13 = 0 AND winner = team2 THEN 'winner_played' END]) AS rule FROM mx) WHERE rule IS NOT NULL""", "m", mixed=True))
def contract_violations(t):
    return quality.violations(_damaged(t), quality.match_rules(), ["match_id"])


@query(sql("""SELECT team_id AS key, 'team of a record' AS rule FROM (SELECT DISTINCT team1_id AS team_id FROM mx UNION SELECT team2_id FROM mx)
 WHERE team_id NOT IN (SELECT team_id FROM trx WHERE facet = 'overall' AND won % 2 = 0)""", "tr", mixed=True))
def orphaned_keys(t):
    rows = materialise(match_rows(t), "matches")
    known = teams.records(rows).where("facet = 'overall' AND won % 2 = 0")
    ids = rows.select(F.explode(F.array("team1_id", "team2_id")).alias("team_id"))
    return quality.orphans(ids, "team_id", known, "team_id", "team of a record")


def _number(column="person_id"):
    return F.substring(column, 2, 9).cast("int")


N = "CAST(SUBSTR(person_id, 2) AS INT)"
SPLIT_KEY = "person_id || '|' || format_key || '|' || dimension || '|' || subject"


def _faults(key: str, table: str, *rules: tuple[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {test} THEN '{rule}' END" for rule, test in rules)
    return f"SELECT key, rule FROM (SELECT {key} AS key, UNNEST([{cases}]) AS rule FROM {table}) WHERE rule IS NOT NULL"


@query(sql(_faults(SPLIT_KEY, "bs", ("dots_of_balls", f"{N} % 5 = 1 AND dimension = 'phase'"), ("scoring", f"{N} % 5 = 1 AND dimension = 'phase'"),
                   ("outs", f"{N} % 7 = 2 AND dimension = 'year'"), ("dimension", f"{N} % 9 = 3 AND dimension = 'position'")), "bs"))
def batting_split_violations(t):
    """Rows of splits with faults put in: too many dots, counters below nothing, dimensions that don't exist."""
    n, d = _number(), F.col("dimension")
    rows = players.batting_splits(t.deliveries, t.people).withColumns({
        "dots": F.when((n % 5 == 1) & (d == "phase"), F.col("balls") + 1).otherwise(F.col("dots")),
        "outs": F.when((n % 7 == 2) & (d == "year"), F.lit(-1)).otherwise(F.col("outs"))})
    found = contract.violations(rows.withColumn("dimension", F.when((n % 9 == 3) & (d == "position"), "place").otherwise(d)), "batting_splits")
    return found.withColumn("key", F.replace("key", F.lit("|place|"), F.lit("|position|")))


@query(sql(_faults(SPLIT_KEY, "bws", ("extras_of_runs", f"{N} % 4 = 1 AND dimension = 'hand'"), ("whole", f"{N} % 6 = 5 AND dimension = 'all'")), "bws"))
def bowling_split_violations(t):
    n, d = _number(), F.col("dimension")
    rows = players.bowling_splits(t.deliveries, t.people).withColumns({
        "wides": F.when((n % 4 == 1) & (d == "hand"), F.col("runs") + 1).otherwise(F.col("wides")),
        "subject": F.when((n % 6 == 5) & (d == "all"), "everything").otherwise(F.col("subject"))})
    found = contract.violations(rows, "bowling_splits")
    return found.withColumn("key", F.replace("key", F.lit("|everything"), F.lit("|all")))


LOG_KEY = "CAST(match_id AS VARCHAR) || '|' || CAST(innings AS VARCHAR) || '|' || person_id"


@query(sql(_faults(LOG_KEY, "bi", ("date", "match_id % 8 = 3"), ("teams", "match_id % 10 = 7"), ("dismissal", "out AND match_id % 6 = 1"))
           + f" UNION ALL SELECT {LOG_KEY}, 'key' FROM bi WHERE match_id % 12 = 5", "bi"))
def batting_log_violations(t):
    """Innings of batters with faults put in, some of them there twice."""
    m, c = F.col("match_id"), F.col
    rows = state.batting_innings(t.deliveries)
    rows = rows.withColumns({
        "date": F.when(m % 8 == 3, "05/2010").otherwise(c("date")), "opposition": F.when(m % 10 == 7, c("team")).otherwise(c("opposition")),
        "dismissal": F.when(c("out") & (m % 6 == 1), "").otherwise(c("dismissal"))})
    twice = rows.where(m % 12 == 5)
    found = contract.violations(rows.unionByName(twice), "batting_innings")
    return found.distinct()


@query(sql(_faults(LOG_KEY, "wi", ("maiden_balls", "match_id % 5 = 2"), ("wickets", "match_id % 7 = 4")), "wi"))
def bowling_log_violations(t):
    m = F.col("match_id")
    rows = state.bowling_innings(t.deliveries)
    return contract.violations(rows.withColumns({
        "maidens": F.when(m % 5 == 2, F.col("balls") + 1).otherwise(F.col("maidens")), "wickets": F.when(m % 7 == 4, F.lit(-2)).otherwise(F.col("wickets"))}), "bowling_innings")


@query(sql(_faults("person_id || '|' || format_key", "car", ("bat_sr", f"{N} % 5 = 0 AND runs IS NOT NULL"), ("highest", f"{N} % 6 = 1 AND runs IS NOT NULL"), ("matches", f"{N} % 8 = 3")), "car"))
def career_violations(t):
    """Careers whose rates aren't those of their counters, whose best is more than all, or without a match."""
    n, c = _number(), F.col
    rows = careers_table(t, False).withColumns({
        "bat_sr": F.when(n % 5 == 0, c("bat_sr") + 1).otherwise(c("bat_sr")), "highest": F.when(n % 6 == 1, c("runs") + 1).otherwise(c("highest")),
        "matches": F.when(n % 8 == 3, F.lit(0)).otherwise(c("matches"))})
    return contract.violations(rows, "careers")


@query(sql(_faults("team_id || '|' || format_key || '|' || facet || '|' || subject", "trx", ("results", "facet = 'year'"), ("span", "facet = 'toss'")), "tr", mixed=True))
def team_record_violations(t):
    c = F.col
    rows = teams.records(match_rows(t)).withColumns({
        "no_result": F.when(c("facet") == "year", c("no_result") + 1).otherwise(c("no_result")),
        "first_date": F.when(c("facet") == "toss", F.concat(c("last_date"), F.lit("x"))).otherwise(c("first_date"))})
    return contract.violations(rows, "team_records")


@query("SELECT CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) AS key, 'unique line' AS rule FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1")
def duplicate_keys(t):
    return quality.duplicates(t.table("lineitem"), ["l_orderkey", "l_linenumber"], "unique line")


@query(sql("""SELECT match_id, innings, CASE WHEN match_id % 9 = 4 THEN 'no replay' ELSE 'totals differ' END AS problem
FROM itx WHERE match_id % 9 = 4 OR (match_id % 7 = 3 AND innings = 2)""", "it", mixed=True))
def reconciled_innings(t):
    """Replay totals against match totals, some replays missing or wrong."""
    totals = match_ops.innings_totals(t.mixed)
    got = totals.where(F.col("match_id") % 9 != 4).withColumn("wickets", F.when(
        (F.col("match_id") % 7 == 3) & (F.col("innings") == 2), F.col("wickets") + 1).otherwise(F.col("wickets")))
    return quality.reconcile_innings(got, totals).select("match_id", "innings", "problem")


@query(sql("""SELECT match_id, person_id, balls, runs, wickets, maidens, 'player' AS only_in FROM wix WHERE match_id % 9 = 4
UNION ALL SELECT match_id, person_id, balls, runs + 1, wickets, maidens, 'replay' FROM wix WHERE match_id % 9 <> 4 AND balls > 10
UNION ALL SELECT match_id, person_id, balls, runs, wickets, maidens, 'player' FROM wix WHERE match_id % 9 <> 4 AND balls > 10""", "wi", mixed=True))
def reconciled_bowling(t):
    """Bowling figures compared as multisets both ways."""
    c = F.col
    logged = materialise(state.bowling_innings(t.mixed), "bowling")
    got = logged.where(c("match_id") % 9 != 4).withColumn(
        "runs", F.when(c("balls") > 10, c("runs") + 1).otherwise(c("runs")))
    return quality.reconcile_bowling(got, logged)


@query(sql(f"""SELECT DISTINCT person_id || '|' || format_key AS key, 'phase sums' AS rule FROM bs WHERE dimension = 'phase' AND {N} % 5 = 2
UNION SELECT person_id || '|' || format_key, 'year sums' FROM bs WHERE dimension = 'year' AND {N} % 7 = 3""", "bs"))
def split_sums(t):
    """Dimensions that cover every ball must add up to the whole; some phases have a run too many, some years are gone."""
    n, d = _number(), F.col("dimension")
    splits = players.batting_splits(t.deliveries, t.people).withColumn("runs", F.when((d == "phase") & (n % 5 == 2), F.col("runs") + 1).otherwise(F.col("runs")))
    splits = materialise(splits.where(~((d == "year") & (n % 7 == 3))), "splits")
    out = quality.split_sums(splits, "phase", players.BAT_COUNTS)
    for dimension in ("entry", "position", "innings_no", "year", "vs_bowler"):
        out = out.unionByName(quality.split_sums(splits, dimension, players.BAT_COUNTS))
    return out


@query(sql(f"""SELECT team_id, format_key, person_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY team_id, format_key ORDER BY wickets DESC, runs_conceded, person_id) AS rank FROM (
 SELECT {TEAM_OF} AS team_id, format_key, person_id, {total('runs')} AS runs_conceded, {total('wickets')} AS wickets, {n_if('match_id % 9 = 4')} AS lost FROM wix GROUP BY 1, 2, 3)) WHERE rank <= 15 AND lost > 0""", "wi", mixed=True))
def reconciled_team_bowlers(t):
    """Teams' leading bowlers whose totals some replays are missing for."""
    logged = materialise(state.bowling_innings(t.mixed), "bowling")
    gender = teams.gender_of_key(F.col("format_key"))
    replayed = logged.where(F.col("match_id") % 9 != 4).withColumn("team_id", text.team_id(F.col("team"), gender))
    return quality.reconcile_team_bowlers(replayed, teams.top_bowlers(logged, gender))


@query(sql("SELECT match_id FROM dx WHERE match_id % 6 = 5 GROUP BY 1", "d", mixed=True))
def explicit_zero_extras(t):
    """Documents that write extras of nothing."""
    def zero(i):
        return i.withField("overs", F.transform(i["overs"], lambda o: o.withField("deliveries", F.transform(o["deliveries"], lambda d: d.withField(
            "extras", F.create_map(F.lit("wides"), F.lit(0)).cast("map<string,int>"))))))

    rows = t.documents(mixed=True)
    rows = rows.withColumn("innings", F.when(F.col("match_id") % 6 == 5, F.transform("innings", zero)).otherwise(F.col("innings")))
    return quality.explicit_zero_extras(rows)


@query(sql(f"""SELECT match_id, innings, {n_if('q % 2 = 1 AND runs_extras > 0')} AS balls, MIN(CASE WHEN q % 2 = 1 AND runs_extras > 0 THEN seq END) AS first_seq
FROM d GROUP BY 1, 2 HAVING COUNT(CASE WHEN q % 2 = 1 AND runs_extras > 0 THEN 1 END) > 0""", "d"))
def extras_mismatches(t):
    rows = t.deliveries.withColumn("runs_extras", F.when(
        (F.col("q") % 2 == 1) & (F.col("runs_extras") > 0), F.col("runs_extras") + 1).otherwise(F.col("runs_extras")))
    return quality.extras_mismatches(rows)


@query(sql("SELECT match_id, COUNT(*) AS balls FROM dx GROUP BY 1", "d", mixed=True))
def replay_sizes(t):
    return sinks.replay_sizes(sinks.replay_documents(t.mixed, match_rows(t)))


@query(sql(f"""SELECT match_id, innings, {total('runs_batter + runs_extras')} AS runs, COUNT(*) AS balls, MIN(seq) AS first_seq, MAX(seq) AS last_seq FROM dx GROUP BY 1, 2""", "d", mixed=True))
def replay_documents(t):
    """Replay documents read back ball by ball."""
    c = F.col
    balls = sinks.explode_replays(sinks.replay_documents(t.mixed, match_rows(t), t.people))
    return balls.groupBy("match_id", "innings").agg(
        F.sum(c("runs_batter") + c("runs_extras")).alias("runs"), F.count(F.lit(1)).alias("balls"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


FILES = """SELECT COALESCE(source, '') AS archive, SHA256(doc_id || '.json' || CHR(9) || SHA256(COALESCE(text, '')) || CHR(9) || COALESCE(LENGTH(text), 0)) AS hash FROM documents"""


def _files(t):
    body = F.coalesce("text", F.lit(""))
    return t.table("documents").select(
        F.coalesce("source", F.lit("")).alias("archive"), F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("name"),
        F.sha2(body, 256).alias("checksum"), F.length(body).alias("size"))


@query(f"""SELECT archive, CAST(SUM(files) AS BIGINT) AS files, SHA256(STRING_AGG(node || CHR(9) || digest, CHR(10) ORDER BY node)) AS sha256 FROM (
 SELECT archive, SUBSTR(hash, 1, 2) AS node, SUM(n) AS files, SHA256(STRING_AGG(hash || CHR(9) || n, CHR(10) ORDER BY hash)) AS digest
 FROM (SELECT archive, hash, COUNT(*) AS n FROM ({FILES}) GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1""")
def fingerprints(t):
    """A digest per source of its documents' names, checksums and sizes, over a tree of two levels."""
    return prints.fingerprint(_files(t), digits=2)


@query(f"""SELECT 'sha256:' || SHA256(STRING_AGG(archive || CHR(9) || sha256, CHR(10) ORDER BY archive)) AS fingerprint FROM (
 SELECT archive, SHA256(STRING_AGG(hash || CHR(9) || n, CHR(10) ORDER BY hash)) AS sha256
 FROM (SELECT archive, hash, COUNT(*) AS n FROM ({FILES}) GROUP BY 1, 2) GROUP BY 1)""")
def input_fingerprint(t):
    """One digest of all documents, over leaves that hold an archive each."""
    return prints.combined(prints.fingerprint(_files(t), digits=0))


@query("SELECT COALESCE(MAX(ts), TIMESTAMP '1970-01-01 00:00:00') AS generated_at FROM events")
def generated_at(t):
    """The dataset's time is that of its newest input."""
    return prints.generated_at(t.table("events").select(F.col("ts").alias("modified_at")))
