"""Scratch/checkpoint folder resolution."""

import pytest

from strike_analytics.session import shared_dir


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" else default


class _SC:
    def __init__(self, master, ckpt=None):
        self.master, self.applicationId, self._ckpt = master, "app-1", ckpt

    def getCheckpointDir(self):
        return self._ckpt

    def setCheckpointDir(self, path):
        self._ckpt = path


class _Spark:
    def __init__(self, master, conf_value=None):
        self.conf, self.sparkContext = _Conf(conf_value), _SC(master)


def test_cluster_without_checkpoint_dir_is_an_error():
    with pytest.raises(RuntimeError):
        shared_dir(_Spark("yarn"), "x")


def test_cluster_uses_the_configured_shared_folder():
    assert shared_dir(_Spark("yarn", "hdfs://nn/ckpt/"), "a", "b") == "hdfs://nn/ckpt/a/b"


def test_local_fallback_is_stable():
    s = _Spark("local[4]")
    assert shared_dir(s, "t") == shared_dir(s, "t")
