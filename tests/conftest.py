import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(autouse=True)
def vocabulary():
    """Plans of the tests go by a vocabulary of their own."""
    from posterboard.functions import vocab

    mine = vocab.Vocabulary(
        strong=["chess", "speed game"], support=["tournament", "tourney", "payout", "entry fee", "powwow"], negative=["video game", "fortnite"], groups=["River", "Riverside"], generic_groups=["Garden Club"],
        towns={"lummi": "Lummi, Washington", "arlee": "Arlee, Montana", "polson": "Polson, Montana", "schurz": "Schurz, Nevada", "ft duchesne": "Fort Duchesne, Utah"},
        synonyms=[(r"\b(?:speed|board) ?games?\b", "chess"), (r"\btourn[a-z0-9_]*\b", "tournament"), (r"\bcompetitions?\b", "tournament")],
    )
    with vocab.using(mine):
        yield mine


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
