import pytest

from disarm.staging import clear_staged, mark


@pytest.fixture(autouse=True)
def staged_folders_go(spark):
    since = mark()
    yield
    clear_staged(spark, since)
