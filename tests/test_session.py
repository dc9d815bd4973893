"""Shared-folder rules for checkpoints and scratch data."""

import pytest

from pairwright.session import checkpoint_root


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master, configured=None):
        self.master, self._dir = master, None
        self._conf = _Conf({"spark.checkpoint.dir": configured} if configured else {})

    def getCheckpointDir(self):
        return self._dir

    def getConf(self):
        return self._conf

    def setCheckpointDir(self, path):
        self._dir = path


class _Session:
    def __init__(self, sc):
        self.sparkContext = sc


def test_cluster_without_checkpoint_dir_is_an_error():
    with pytest.raises(RuntimeError):
        checkpoint_root(_Session(_Context("yarn")))


def test_configured_dir_is_used_as_is():
    assert checkpoint_root(_Session(_Context("yarn", "hdfs:///shared/ckpt"))) == "hdfs:///shared/ckpt"


def test_local_mode_gets_a_local_folder():
    assert checkpoint_root(_Session(_Context("local[2]"))).startswith("/")
