import os

from corvana.session import forget, stored


def test_stored_tables_are_deleted_when_forgotten(spark):
    df = stored(spark.range(5).toDF("id"), "kept")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.isdir(path)
    assert forget() >= 1 and not os.path.exists(path)
    assert forget() == 0
