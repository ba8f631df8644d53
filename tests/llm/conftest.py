import pytest


@pytest.fixture(scope="module", autouse=True)
def _files_removed(spark):
    """What a module's operators wrote goes when its tests are done."""
    from statloom.llm import shared

    yield
    shared.remove_all(spark)
