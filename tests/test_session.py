from types import SimpleNamespace

import pytest

from vulnlake.session import checkpoint_folder


def _session(master, folder=None):
    kept = {"spark.checkpoint.dir": folder} if folder else {}
    conf = SimpleNamespace(get=lambda key, other: kept.get(key, other), set=kept.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_a_set_folder_is_taken_as_it_is():
    assert checkpoint_folder(_session("spark://h:7077", "hdfs:///x")) == "hdfs:///x" == checkpoint_folder(_session("local[2]", "hdfs:///x"))


@pytest.mark.parametrize("master", ["spark://h:7077", "yarn", "local-cluster[3,2,1024]", "k8s://h"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        checkpoint_folder(_session(master))


def test_a_local_session_makes_its_own_once():
    session = _session("local[4]")
    assert checkpoint_folder(session) == checkpoint_folder(session)
