import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from spendwatch.session import get_session

    scratch = tempfile.mkdtemp(prefix="spendwatch-test-")
    s = get_session("local[4]", shuffle_partitions=8,
                    extra={"spark.checkpoint.dir": scratch, "spark.sql.warehouse.dir": scratch + "/wh"})
    yield s
    from spendwatch.sources import tables
    tables.drop_stages(s)
    s.stop()


SF = "/root/testdata/sf0.001"
