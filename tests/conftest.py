import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wirelore.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


EVENT_DDL = """t double, si string, sp int, di string, dp int, pr string, bytes_sent long, bytes_recv long,
    dns_query string, tls_sni string, tls_ja3 string"""


@pytest.fixture
def make_events(spark):
    def make(rows):
        names = [x.split()[0] for x in EVENT_DDL.replace("\n", " ").split(",")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], EVENT_DDL)

    return make
