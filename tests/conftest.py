import pathlib
import sys

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(pathlib.Path(__file__).resolve().parents[k]) for k in (1, 0)]

from helpers import d  # noqa: E402

from filigree.sources.tables import SCHEMAS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .appName("filigree-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def facts(spark):
    """Builds a fact table from (concept, value, start, end, filed, accession) tuples."""

    def build(*rows, cik="0000000001"):
        out = []
        for concept, value, start, end, filed, accession, *rest in rows:
            unit = rest[0] if rest else "USD"
            taxonomy = "dei" if concept.startswith("Entity") else "us-gaap"
            form = "10-K" if start is None or (d(end) - d(start)).days > 340 else "10-Q"
            out.append((cik, taxonomy, concept, unit, float(value), d(start), d(end), int(filed[:4]), None, form, d(filed),
                        accession, None, 1))
        return spark.createDataFrame(out, SCHEMAS["financial_facts"])

    return build


@pytest.fixture
def table(spark):
    """Builds a stored table from dicts; columns not given are NULL."""

    def build(name, *rows):
        names = [c.strip().split(" ")[0] for c in SCHEMAS[name].split(",")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMAS[name])

    return build
