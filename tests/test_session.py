from types import SimpleNamespace

import pytest

from orderlens.session import SQL_SETTINGS, configure, keep, work_dir


def stub(master, setting=None, context_dir=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: setting),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: context_dir),
    )


def test_shared_folder_comes_from_the_session():
    assert work_dir(stub("yarn", "hdfs://shared/work/")) == "hdfs://shared/work"
    assert work_dir(stub("yarn", None, "hdfs://other")) == "hdfs://other"


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_dir(stub("spark://host:7077"))


def test_settings_are_applied(spark):
    configure(spark)
    assert all(spark.conf.get(k) == v for k, v in SQL_SETTINGS.items())


def test_kept_rows_no_longer_depend_on_their_source(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    kept = keep(spark.read.parquet(path).groupBy().count())
    spark.range(7).write.mode("overwrite").parquet(path)
    assert kept.first()[0] == 5
