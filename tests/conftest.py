import pytest

from nearlabel.session import local_session, work_dir


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, app="tests", spark__sql__shuffle__partitions="4")
    work_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
