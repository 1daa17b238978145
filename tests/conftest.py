import pytest

from scoreloom.session import build


@pytest.fixture(scope="session")
def spark():
    session = build("local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield session
    session.stop()
