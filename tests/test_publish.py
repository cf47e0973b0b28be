"""Snapshots, guards, fingerprints and side tables."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from overstats.operators import identity, publish
from overstats.sources import fingerprint, metadata
from tests.hand import save


def table(spark, rows):
    return spark.createDataFrame(rows, "id int, format_key string, v string")


def counts(df):
    return {r.status: r.n for r in df.collect()}


def test_publish_is_incremental_idempotent_and_scoped(spark, tmp_path):
    root = str(tmp_path / "things")
    first = table(spark, [(1, "odi-m", "a"), (2, "odi-m", "b"), (3, "t20i-m", "c")])
    assert counts(publish.publish(spark, root, first, ["id"])) == {"inserted": 3}
    before = publish.current_path(spark, root)
    assert counts(publish.publish(spark, root, first, ["id"])) == {"unchanged": 3}
    assert publish.current_path(spark, root) == before
    second = table(spark, [(1, "odi-m", "A"), (4, "odi-m", "d")])
    got = publish.publish(spark, root, second, ["id"], scope=F.col("format_key") == "odi-m")
    assert counts(got) == {"updated": 1, "deleted": 1, "inserted": 1}
    assert {tuple(r) for r in publish.read_snapshot(spark, root).collect()} == {
        (1, "odi-m", "A"), (4, "odi-m", "d"), (3, "t20i-m", "c")}
    found, missing = publish.open_snapshots(spark, str(tmp_path), ["things", "others"])
    assert list(found) == ["things"] and missing == ["others"]


def folders(spark, root):
    return publish.current(spark, root)["folders"]


def test_one_changed_row_writes_one_bucket(spark, tmp_path):
    root = str(tmp_path / "rows")
    rows = [(k, "odi-m", "a") for k in range(200)]
    publish.publish(spark, root, table(spark, rows), ["id"], buckets=16)
    before = folders(spark, root)
    assert len(before) == 16
    changed = [(k, f, "b" if k == 77 else v) for k, f, v in rows]
    assert counts(publish.publish(spark, root, table(spark, changed), ["id"])) == {"updated": 1, "unchanged": 199}
    after = folders(spark, root)
    assert sum(before[b] != after[b] for b in before) == 1
    assert {tuple(r) for r in publish.read_snapshot(spark, root).collect()} == set(changed)
    publish.publish(spark, root, table(spark, [r for r in changed if r[0] != 77]), ["id"])
    assert publish.read_snapshot(spark, root).count() == 199
    gone = publish.drop_unused(spark, root, keep=1)
    assert len(gone) == 1 and publish.read_snapshot(spark, root).count() == 199  # the first folder still holds most buckets


def test_the_second_of_two_writers_is_refused(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "rows")
    publish.publish(spark, root, table(spark, [(1, "odi-m", "a")]), ["id"])
    stale = publish.current(spark, root)
    publish.publish(spark, root, table(spark, [(1, "odi-m", "b")]), ["id"])
    with pytest.raises(publish.Conflict):
        publish.publish(spark, root, table(spark, [(1, "odi-m", "c")]), ["id"], seen=stale["version"])
    monkeypatch.setattr(publish, "current", lambda *_: stale)  # both began before either had switched
    with pytest.raises(publish.Conflict):
        publish.publish(spark, root, table(spark, [(1, "odi-m", "d")]), ["id"])
    monkeypatch.undo()
    assert [r.v for r in publish.read_snapshot(spark, root).collect()] == ["b"]
    assert publish.current(spark, root)["version"] == 2


def test_a_version_cut_short_changes_nothing(spark, tmp_path):
    root = tmp_path / "rows"
    publish.publish(spark, str(root), table(spark, [(1, "odi-m", "a")]), ["id"])
    (root / "_versions" / "000000002.json").write_text('{"version": 2, "fold')
    assert publish.read_snapshot(spark, str(root)).count() == 1
    publish.publish(spark, str(root), table(spark, [(1, "odi-m", "b")]), ["id"])
    assert publish.current(spark, str(root))["version"] == 3 and publish.read_snapshot(spark, str(root)).first().v == "b"


def test_null_keys_new_columns_and_kept_rows(spark, tmp_path):
    root = str(tmp_path / "rows")
    publish.publish(spark, root, table(spark, [(None, "odi-m", "a"), (1, None, "b"), (2, "odi-m", None)]), ["id"], buckets=4)
    same = table(spark, [(None, "odi-m", "a"), (1, None, "b"), (2, "odi-m", None)])
    assert counts(publish.publish(spark, root, same, ["id"])) == {"unchanged": 3}
    wider = spark.createDataFrame([(1, None, "b", 5), (3, "odi-m", "c", 6)], "id int, format_key string, v string, w int")
    assert counts(publish.publish(spark, root, wider, ["id"], deletes=False)) == {"updated": 1, "inserted": 1, "unchanged": 2}
    assert {tuple(r) for r in publish.read_snapshot(spark, root).collect()} == {
        (None, "odi-m", "a", None), (1, None, "b", 5), (2, "odi-m", None, None), (3, "odi-m", "c", 6)}
    assert counts(publish.publish(spark, root, wider, ["id"], deletes=False)) == {"unchanged": 4}


def test_only_live_data_is_published():
    publish.assert_live("live")
    with pytest.raises(ValueError):
        publish.assert_live("demo")


def test_run_log_keeps_the_last_complete_run(spark, tmp_path):
    path = str(tmp_path / "runs")
    for i in range(4):
        publish.append_run(spark, path, {
            "run_id": f"r{i}", "status": "complete" if i == 0 else "failed", "started_at": None,
            "finished_at": datetime(2024, 1, 1 + i), "fingerprint": "f", "partial": False,
            "counts": {"matches": 1}, "changes": {}})
    runs = spark.read.parquet(path)
    assert {r.run_id for r in publish.retained_runs(runs, 2).collect()} == {"r3", "r2", "r0"}
    assert publish.active_run(runs).first().run_id == "r0"
    current = spark.createDataFrame([("f",)], "fingerprint string")
    assert fingerprint.unchanged(spark, current, runs)


def test_fingerprint_ignores_folders_and_sees_content(spark, tmp_path):
    one = save(tmp_path / "a", m1="{}", m2='{"x":1}')
    save(tmp_path / "b" / "deep", m2='{"x":1}')
    two = save(tmp_path / "b", m1="{}")
    changed = save(tmp_path / "c", m1="{}", m2='{"x":2}')
    def digest(path):
        rows = fingerprint.files(spark, path).withColumn("archive", F.lit("all"))
        return fingerprint.combined(fingerprint.fingerprint(rows)).first()[0]
    assert digest(one) == digest(two) != digest(changed)


def test_fingerprint_trees_of_any_depth_tell_archives_apart(spark, monkeypatch):
    rows = [("a", f"f{k}", "c", k % 7) for k in range(600)] + [("a", "twice", "c", 1)] * 3 + [("b", "f1", "c", 1)]
    table = lambda r: spark.createDataFrame(r, "archive string, name string, checksum string, size long")
    digests = lambda r: {x.archive: (x.files, x.sha256) for x in fingerprint.fingerprint(table(r)).collect()}
    flat = digests(rows)
    assert flat["a"][0] == 603 and flat["b"][0] == 1
    monkeypatch.setattr(fingerprint, "LEAF", 1)  # several levels
    deep = digests(rows)
    assert deep == digests(rows[::-1]) and deep["a"][1] != flat["a"][1]
    assert digests(rows[:-1] + [("b", "f1", "c", 2)])["a"] == deep["a"]
    assert digests(rows[1:])["a"] != deep["a"] and digests([*rows, rows[601]])["a"] != deep["a"]


def test_styles_file_with_a_comment_header(spark, tmp_path):
    path = tmp_path / "styles.csv"
    path.write_text("# about\n# more\nname,bowling_type,batting_hand,role,country,cricinfo_id,source\n"
                    "A One,Right arm fast-medium,rhb,Bowler,India,,x\nB Two,mystery,,,,7,\n,lb,,,,,\n")
    got = {r.name: r for r in metadata.style_rows(
        metadata.read_csv(spark, str(path), comment="#"), "file").collect()}
    assert got["A One"].bowling_type == "rfm" and got["A One"].batting_hand == "right"
    assert got["B Two"].bowling_type == "mystery" and got["B Two"].source == "file" and len(got) == 2


def test_metadata_by_id_then_unique_name_and_country(spark):
    people = spark.createDataFrame(
        [("SR T", "p1", "male", "United States of America"), ("SR T", "p2", "female", "West Indies"),
         ("V K", "p3", "male", "India"), ("J R", "p4", "male", "England"), ("D D", "p5", "male", "India")],
        "name string, person_id string, gender string, team string")
    cols = "name string, bowling_type string, batting_hand string, role string, country string, " \
           "external_id string, full_name string, row_id string, row_no long"
    row = lambda name, country, n, ext="", rid="": (name, "ob", "right", "", country, ext, name, rid, n)
    layer = spark.createDataFrame([
        row("SR T", "Barbados", 1), row("V K", "India", 2), row("J R", "India", 3),
        row("D D", "India", 4), row("D D", "India", 5), row("Z", "Wales", 6, ext="e4")], cols)
    register = spark.createDataFrame([("e4", "p4")], "external_id string, person_id string")
    good, bad = identity.resolve_metadata(people, [layer], register)
    assert {r.person_id: r.via for r in good.collect()} == {"p3": "name", "p4": "id"}
    assert {r.person_id: r.reasons for r in bad.collect()} == {
        "p1": ["ambiguous_name"], "p2": ["ambiguous_name"], "p5": ["duplicate_rows"]}


def test_a_partial_build_keeps_rows_it_does_not_have(spark, tmp_path):
    from overstats.plans import build

    names = lambda *rows: spark.createDataFrame(rows, "person_id string, name string")
    root, key = str(tmp_path / "partial"), build.KEYS["names"]
    assert list(key) == ["person_id"]
    build.write(spark, build.Build({"names": names(("a", "Ann"), ("b", "Bo"))}, None), root)
    build.write(spark, build.Build({"names": names(("b", "Bob"), ("c", "Cy"))}, None), root, ["odi-m"])
    got = publish.read_snapshot(spark, f"{root}/names").collect()
    assert {(r.person_id, r.name) for r in got} == {("a", "Ann"), ("b", "Bob"), ("c", "Cy")}
