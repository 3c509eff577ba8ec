import pytest

from lodestone.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cores="4", shuffle=4)
