import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]").appName("veilmark-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return session


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    return SF


BOX_SCHEMA = (
    "video_id string, frame_idx int, time_ms int, box_ord int, text string, confidence double,"
    "bbox struct<x:int,y:int,w:int,h:int>"
)


@pytest.fixture(scope="session")
def make_boxes(spark):
    def make(rows):
        """rows: (frame_idx, text, (x, y, w, h)) of one video."""
        seen = {}
        out = []
        for frame, text, bbox in rows:
            seen[frame] = seen.get(frame, -1) + 1
            out.append(("v", frame, frame * 100, seen[frame], text, 0.9, bbox))
        return spark.createDataFrame(out, BOX_SCHEMA)

    return make


@pytest.fixture(scope="session")
def make_cands(spark):
    def make(rows, video="v"):
        """rows: (time_ms, x, y[, type[, confidence]])."""
        out = []
        for i, row in enumerate(rows):
            t, x, y, kind, conf = (*row, *("phone", 0.9)[len(row) - 3:]) if len(row) < 5 else row
            out.append((video, kind, t, i, conf, x, y, 80, 20, "555-1234"))
        return spark.createDataFrame(
            out, "video_id string, pii_type string, time_ms long, cand_ord long, confidence double,"
            "x int, y int, w int, h int, text string",
        )

    return make
