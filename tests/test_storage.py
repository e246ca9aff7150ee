"""Shared folders and shipping, for sessions in one process and for clusters."""

import zipfile

import pytest

from brindle import storage


class Conf(dict):
    def set(self, key, value):
        self[key] = value

    def get(self, key, default=None):
        return super().get(key, default)


class Session:
    """What the functions use of a session."""

    def __init__(self, master, **conf):
        self.conf, self.sparkContext, self.shipped, self.environment = Conf({"spark.master": master} | conf), self, [], {}
        self.addPyFile = self.shipped.append


@pytest.mark.parametrize("master", ["spark://head:7077", "yarn", "k8s://https://head", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session(master))
    assert storage.shared_dir(Session(master, **{"spark.checkpoint.dir": "hdfs://store/shared/"})) == "hdfs://store/shared"


def test_one_process_gets_one_folder():
    session = Session("local[4]")
    assert storage.shared_dir(session) == storage.shared_dir(session)


def test_a_cluster_gets_the_package_once():
    session = Session("yarn")
    storage.workers_import_this(session)
    storage.workers_import_this(session)
    assert len(session.shipped) == 1 and session.environment == {}
    assert "brindle/storage.py" in zipfile.ZipFile(session.shipped[0]).namelist()
    local = Session("local-cluster[3,2,1024]")
    storage.workers_import_this(local)
    assert not local.shipped and "PYTHONPATH" in local.environment
