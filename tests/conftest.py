import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))
DATA = Path(os.environ.get("MIREFOLD_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from mirefold.session import local_session

    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """Folder of the smallest test tables."""
    if not (DATA / "sf0.001").exists():
        pytest.skip("no test tables here")
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in Path(small).iterdir():
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con
