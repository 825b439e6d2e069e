import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from liasse.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", "4")
    # Tiny tables: compiling each stage would be most of the time.
    for key, value in (("spark.sql.shuffle.partitions", "2"), ("spark.sql.codegen.wholeStage", "false")):
        session.conf.set(key, value)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Values of a column expression over a list of texts."""
    def run(texts, expression):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, texte string")
        return [r[0] for r in rows.select(expression.alias("x"), "i").orderBy("i").select("x").collect()]
    return run
