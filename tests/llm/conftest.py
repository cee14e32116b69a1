import pytest


@pytest.fixture(autouse=True)
def own_checkpoint(spark, tmp_path_factory):
    """A shared folder for staged tables where the session has none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
