from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from querygauge.session import local_session

    return local_session(4, shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def smoke_dir():
    return "/root/testdata/sf0.001"
