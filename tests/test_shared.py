"""Where tables between steps lie."""

import os
from types import SimpleNamespace

import pytest

from faturalens.plans.shared import clear_written, shared_folder, written


def session(master, named=None):
    seen = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: seen[-1] if seen else None, setCheckpointDir=seen.append)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_named_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session(master))
    assert shared_folder(session(master, "/shared")) == "/shared"


def test_one_machine_gets_a_folder_of_its_own():
    assert os.path.isdir(shared_folder(session("local[4]")))


def test_written_tables_can_be_removed(spark, tmp_path):
    before = shared_folder(spark)
    try:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
        assert written(spark.range(3)).count() == 3
        inside = shared_folder(spark).removeprefix("file:")
        assert len(os.listdir(inside)) == 1
        clear_written(spark)
        assert os.listdir(inside) == []
    finally:
        spark.sparkContext.setCheckpointDir(before)
