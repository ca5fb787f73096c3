import pytest


@pytest.fixture(scope="session")
def spark():
    from okrug.session import get_spark

    return get_spark("tests", cores=4)
