import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rubrica.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": "/tmp/wh",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()
