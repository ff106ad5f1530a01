import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from featpipe.session import build_session

    s = build_session("local[4]", app="featpipe-tests", shuffle_partitions=4,
                      extra={"spark.driver.memory": "4g", "featpipe.ordered.buckets": "8"})
    yield s
    s.stop()
