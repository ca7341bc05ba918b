import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from wayloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cores=8, partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Rows to a DataFrame with tile 1 in front unless the schema names tile_id."""
    def make(rows, schema, tile=1):
        if "tile_id" not in schema:
            rows, schema = [(tile, *r) for r in rows], "tile_id bigint, " + schema
        return spark.createDataFrame([tuple(r) for r in rows], schema)

    return make
