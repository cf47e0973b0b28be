"""Manifests of old, new, odd and broken builds."""

from __future__ import annotations

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from overstats.sources import manifests


def builds(spark, *texts):
    return spark.createDataFrame([(str(k), "complete", k, t) for k, t in enumerate(texts)], "run_id string, status string, finished_at long, manifest string")


def test_the_first_version_gets_keys_and_defaults(spark):
    old = {"generated": "2020-01-02T03:04:05", "playerCount": 3, "formats": {"test": {"label": "Test", "matches": 2, "lastDate": "2019-12-31"}, "odi": None}, "thresholds": {"venueMinInnings": 9}}
    row = manifests.normalised(builds(spark, json.dumps(old))).first()
    assert (row.version, row.build_id, row.fingerprint, row.match_count) == (1, "2020-01-02T03:04:05-v1", None, None)
    assert list(row.formats) == ["test-m"] and row.formats["test-m"].gender == "male" and row.formats["test-m"].matches == 2
    assert row.thresholds == {"venueMinInnings": 9.0, "teamMinMatches": 5.0}
    meta = manifests.dataset_meta(builds(spark, json.dumps(old))).first()
    assert meta.data_as_of == "2019-12-31" and meta.phases is None


def test_empty_and_null_manifests(spark):
    row, nothing = manifests.normalised(builds(spark, '{"generated":"2020-01-02T00:00:00"}', None)).orderBy("run_id").collect()
    assert row.version == 1 and row.formats == {} and row.thresholds == {"teamMinMatches": 5.0, "venueMinInnings": 3.0}
    assert nothing.version is None and nothing.build_id is None
    assert manifests.dataset_meta(builds(spark, '{"generated":"2020-01-02T00:00:00"}')).first().data_as_of == "2020-01-02"
    assert manifests.dataset_meta(builds(spark)).count() == 0


@pytest.mark.parametrize("text", ['{"schemaVersion":3}', '{"schemaVersion":"x"}', "{"])
def test_unknown_versions_and_broken_texts_fail(spark, text):
    with pytest.raises((PySparkException, Py4JJavaError)):
        manifests.normalised(builds(spark, text)).collect()
