import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from lintlake.plans.scan import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sources(spark):
    """Make ``(repo, path, ext, content)`` rows from a dict of path to text."""

    def make(files: dict[str, str], repo: str = "r"):
        rows = [(repo, p, "." + p.rsplit(".", 1)[-1], t) for p, t in files.items()]
        return spark.createDataFrame(rows, "repo string, path string, ext string, content string")

    return make


def sample(name: str) -> str:
    return (ROOT / "tests" / "samples" / name).read_text()
