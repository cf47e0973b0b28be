from __future__ import annotations

import pytest

from overstats.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
    })
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
