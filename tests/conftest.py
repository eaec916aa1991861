import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fieldframe.session import get_spark

    import tempfile

    wh = tempfile.mkdtemp(prefix="ff-warehouse-", dir="/tmp")
    s = get_spark(master="local[4]", shuffle_partitions=8, app="fieldframe-tests",
                  extra={"spark.sql.warehouse.dir": wh})
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"
