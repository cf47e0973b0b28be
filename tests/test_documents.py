"""Hand documents, one rule at a time."""

from __future__ import annotations

import json
import time

from pyspark.sql import functions as F

from overstats.operators import matches, players, state
from overstats.sources import documents as docs
from tests.hand import ball, innings, match, save

PEOPLE = {"A": "a1", "B": "b1", "C": "c1", "X": "x1", "Y": "y1"}
B = lambda *a, **k: ball("A", "X", "B", *a, **k)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_scan_skips_unreadable_filters_gender_and_limits(spark, tmp_path):
    doc = match(innings("India", [B(1)]), people=PEOPLE)
    women = match(innings("India", [B(1)]), people=PEOPLE, gender="female")
    path = save(tmp_path / "m", a1=doc, a2="{not json", a3=women, a4=doc)
    assert {r.match_id for r in docs.read_documents(spark, path, "odi").collect()} == {"a1", "a3", "a4"}
    men = docs.read_documents(spark, path, "odi", gender="male", limit=1).collect()
    assert [(r.match_id, r.format_key) for r in men] == [("a1", "odi-m")]


def flat(spark, tmp_path, doc, fmt="t20i"):
    return docs.flatten(docs.read_documents(spark, save(tmp_path / "m", m1=doc), fmt))



def test_the_newest_file_says_the_gender(spark, tmp_path):
    people = lambda gender: match(innings("India", [B(1)]), people=PEOPLE, gender=gender)
    path = save(tmp_path / "in", m1=people("female"), m2=people("female"), m3=people("male"))
    time.sleep(1.1)
    (tmp_path / "in" / "m1.r2.json").write_text(json.dumps(people("male")))
    (tmp_path / "in" / "m3.r2.json").write_text("{")  # the newest that can be read
    read = lambda gender: sorted(r.match_id for r in docs.read_documents(spark, path, "odi", gender=gender).collect())
    assert read("female") == ["m2"] and read("male") == ["m1", "m3"]
    alone = save(tmp_path / "alone", m1=people("male"))
    assert "Exchange" not in docs.read_documents(spark, alone, "odi")._jdf.queryExecution().executedPlan().toString()


def test_legal_faced_dots_and_running_columns(spark, tmp_path):
    doc = match(innings("India", [
        B(0), B(0, {"wides": 1}), B(1, {"noballs": 1}), B(0, {"byes": 2}),
        B(4), B(0, {"legbyes": 1}), B(0, out=[("bowled", "A")]),
    ]), people=PEOPLE)
    out = rows(state.running_state(flat(spark, tmp_path, doc)).orderBy("seq"))
    assert [r["is_legal"] for r in out] == [True, False, False, True, True, True, True]
    assert [r["is_faced"] for r in out] == [True, False, True, True, True, True, True]
    assert [r["is_dot"] for r in out] == [True, False, False, False, False, False, True]
    assert [r["is_bowler_dot"] for r in out] == [True, False, False, False, False, False, True]
    assert [r["ball_no"] for r in out] == [1, 1, 1, 2, 3, 4, 5]
    assert [r["score_before"] for r in out] == [0, 0, 1, 3, 5, 9, 10]
    assert [r["conceded"] for r in out] == [0, 1, 2, 0, 4, 0, 0]
    assert out[6]["credited_kind"] == "bowled" and out[6]["striker_out_kind"] == "bowled"


def test_super_over_is_numbered_but_skipped_and_missing_names_are_marked(spark, tmp_path):
    stranger = ball("Nobody", "X", "B", 1)
    doc = match(innings("India", [B(1)]), innings("England", [B(2)], target={"runs": 2, "overs": 20}),
                innings("India", [B(6)], super_over=True), innings("England", [stranger]), people=PEOPLE)
    out = rows(flat(spark, tmp_path, doc).orderBy("innings", "seq"))
    assert [(r["innings"], r["played_no"], r["chasing"]) for r in out] == [
        (1, 1, False), (2, 2, True), (4, 3, False)]
    assert out[2]["batter_id"] == "~Nobody"
    assert [r["bowling_team"] for r in out] == ["England", "India", "India"]


def test_only_the_fourth_innings_of_a_test_is_a_chase(spark, tmp_path):
    doc = match(*[innings(t, [B(1)]) for t in ("India", "England", "India", "England")], people=PEOPLE)
    out = rows(flat(spark, tmp_path, doc, "test").orderBy("innings"))
    assert [r["chasing"] for r in out] == [False, False, False, True]


def test_retired_hurt_returns_and_dismissals_at_both_ends(spark, tmp_path):
    doc = match(innings("India", [
        B(1), B(0, out=[("retired hurt", "A")]),
        ball("C", "X", "B", 0, out=[("caught", "C"), ("timed out", "D")]),
        ball("A", "X", "B", 4), ball("A", "X", "B", 0, out=[("run out", "B")]),
    ]), people=PEOPLE | {"D": "d1"})
    log = {r["person_id"]: r for r in rows(state.batting_innings(flat(spark, tmp_path, doc)))}
    assert {p: (r["position"], r["out"], r["dismissal"]) for p, r in log.items()} == {
        "a1": (1, False, ""), "b1": (2, True, "run out"), "c1": (3, True, "caught"),
        "d1": (4, True, "timed out")}
    assert log["c1"]["dismissed_by_id"] == "x1" and log["b1"]["dismissed_by_id"] == ""
    assert log["b1"]["outs_other_end"] == 1 and log["d1"]["balls"] == 0
    assert log["a1"]["runs"] == 5


def test_retirement_is_shown_while_the_batter_stays_away(spark, tmp_path):
    doc = match(innings("India", [B(1, out=[("retired hurt", "A")]), ball("C", "X", "B", 1)]), people=PEOPLE)
    log = {r["person_id"]: r for r in rows(state.batting_innings(flat(spark, tmp_path, doc)))}
    assert (log["a1"]["out"], log["a1"]["dismissal"]) == (False, "retired hurt")


def test_maiden_needs_six_legal_balls_and_no_runs_charged(spark, tmp_path):
    byes = [B(0, {"byes": 1})] + [B(0)] * 5
    short = [B(0)] * 5
    doc = match(innings("India", byes, short, [B(0)] * 5 + [B(1)]), people=PEOPLE)
    (fig,) = rows(state.bowling_innings(flat(spark, tmp_path, doc)))
    assert (fig["balls"], fig["runs"], fig["maidens"]) == (17, 1, 1)


def test_partnerships_and_a_second_wicket_on_one_ball(spark, tmp_path):
    doc = match(innings("India", [
        B(2), B(0, out=[("caught", "A"), ("timed out", "C")]), ball("D", "X", "B", 3),
    ]), people=PEOPLE | {"D": "d1"})
    stands = sorted(
        (r["first_seq"], r["extra_no"], r["wicket"], r["low_id"], r["high_id"], r["runs"], r["balls"], r["unbroken"])
        for r in rows(state.partnerships(flat(spark, tmp_path, doc))))
    assert stands == [
        (1, 0, 1, "a1", "b1", 2, 2, False), (2, 1, 2, "b1", "c1", 0, 0, False),
        (3, 0, 3, "b1", "d1", 3, 1, True)]
    falls = sorted((r["wicket"], r["runs"], r["person_id"], r["label"])
                   for r in rows(state.fall_of_wickets(flat(spark, tmp_path, doc))))
    assert falls == [(1, 2, "a1", "0.2"), (2, 2, "c1", "0.2")]


def test_labels_repeat_on_a_wide(spark, tmp_path):
    doc = match(innings("India", [B(1), B(0, {"wides": 1}), B(1)], [B(2)]), people=PEOPLE)
    out = rows(state.timeline(flat(spark, tmp_path, doc)).orderBy("seq"))
    assert [r["label"] for r in out] == ["0.1", "0.2", "0.2", "1.1"]


def test_totals_include_penalties_and_results_read_as_scorecards(spark, tmp_path):
    first = innings("India", [B(4)], penalty_runs={"pre": 5, "post": 1}, declared=True)
    doc = match(first, innings("England", [B(6)], target={"runs": 11, "overs": 20}), people=PEOPLE,
                outcome={"winner": "India", "by": {"innings": 1, "runs": 4}, "method": "D/L"},
                missing=["umpires", {"powerplays": {"1": []}}, "umpires"], overs=20)
    d = docs.read_documents(spark, save(tmp_path / "m", m1=doc), "t20i")
    totals = matches.innings_totals(docs.flatten(d), docs.innings_facts(d))
    head = docs.headers(d).withColumns({"venue_key": F.lit("Eden Gardens"), "country": F.lit("India")})
    (row,) = rows(matches.match_rows(head, totals))
    assert [(i["runs"], i["penalty_runs"], i["declared"]) for i in row["innings"]] == [(10, 6, True), (6, 0, False)]
    assert row["result_text"] == "India won by an innings and 4 runs (D/L method)"
    assert row["missing"] == ["umpires", "powerplays"] and row["has_replay"]
    assert row["first_innings_total"] is None


def test_two_people_with_one_name_and_the_latest_name(spark):
    names = spark.createDataFrame(
        [("p1", "odi-m", "2020-01-01", "m1", "Old"), ("p1", "odi-m", "2021-01-01", "m2", "New"),
         ("p2", "odi-m", "2020-01-01", "m1", "New")],
        "person_id string, format_key string, date string, match_id string, name string")
    got = {r.person_id: r.name for r in players.display_names(players.latest_names(names)).collect()}
    assert got == {"p1": "New", "p2": "New"}
