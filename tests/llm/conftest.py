import pytest

from gitloom.llm.common import small_batches
from gitloom.session import ship


@pytest.fixture(autouse=True)
def ready(spark):
    small_batches(spark)
    ship(spark)
