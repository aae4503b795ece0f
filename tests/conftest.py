import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from folio.sources.tables import FILES_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "America/Lima")  # results must not depend on it
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files_table(spark):
    """Files table from {(corpus, path): bytes}."""

    def build(entries):
        from datetime import datetime, timezone

        moment = datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
        rows = [
            (corpus, path, "file", len(raw), moment, "644", None, bytearray(raw), None)
            for (corpus, path), raw in entries.items()
        ]
        return spark.createDataFrame(rows, FILES_SCHEMA)

    return build


@pytest.fixture
def evaluate(spark):
    """Values of an expression over a list of texts (column `x`)."""

    def run(expression, values, kind="STRING"):
        rows = spark.createDataFrame(list(enumerate(values)), f"i INT, x {kind}")
        return [r[1] for r in sorted(rows.selectExpr("i", f"{expression} AS y").collect())]

    return run


@pytest.fixture
def shore(tmp_path):
    """A tree four folders deep: a table, a log, notes without extension, control bytes, a named link, an empty folder."""
    root = tmp_path / "shore"
    for folder in ("maps/old/1890/east", "tides", "maps/blank", ".svn"):
        (root / folder).mkdir(parents=True)
    (root / "birds.csv").write_text("name;seen\nknot;12\ncurlew;7\n")
    (root / "maps" / "NOTES").write_text("north is up")
    (root / "maps" / "old" / "1890" / "east" / "inlet.geo").write_text("POINT 3 4\r\nPOINT 5 6\r\n")
    (root / "tides" / "gauge.dat").write_bytes(bytes(range(1, 9)) * 5)
    (root / "tides" / "week.log").write_text("mon 2.1\n")
    (root / ".svn" / "entries").write_text("12\n")
    (root / "newest").symlink_to(root / "maps" / "NOTES")
    return root
