import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from episodium.session import local_session

    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session(
        8, "episodium-tests", **{"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": folder + "/wh"}
    )
    yield session
    session.stop()


SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def folder():
    return SMALL
