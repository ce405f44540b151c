import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()


TEXTS = [
    "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega",
    "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega",
    "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi OMEGA end",
    None,
    "",
    "word",
    " \t\n ",
    "call +1 (743) 555-3824 or 743-555-3824, mail a.b@c.de, ip 10.0.0.1, card 4111 1111 1111 1111é",
    "Released under the MIT License.\n\nÜber straße 日本語 mit license",
    "x " * 30_000,
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, a repeated row, and columns named as the
    operators name theirs."""
    rows = [(i, t, ["en", None, "de"][i % 3], ["src0", "src1", None][i % 3], len(t or ""), i, "x", 1.5) for i, t in enumerate(TEXTS)]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, before long, _h string, mix_tokens double")
