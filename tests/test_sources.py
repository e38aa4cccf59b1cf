from types import SimpleNamespace

import pytest

from vecledger.sources import tables


def test_shared_folder_is_that_of_the_session(spark):
    assert tables.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]"))
    with pytest.raises(RuntimeError):
        tables.shared_folder(cluster)


def test_written(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    back = tables.written(df)
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, None)]
    assert back.schema["n"].dataType == df.schema["n"].dataType
    assert tables.written(df.where("false")).count() == 0
