"""Where intermediate tables go, and what a missing library takes away."""

import builtins

import pytest

import __spark_entry__ as E
from cohortflow import session as se


class Conf(dict):
    def set(self, key, value):
        self[key] = value


class Context:
    def __init__(self, master):
        self.master, self.dir = master, None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


class Session:
    def __init__(self, context=None, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})
        if context is not None:
            self.sparkContext = context


def test_a_cluster_or_a_remote_session_needs_a_shared_folder():
    for s in (Session(Context("spark://host:7077")), Session(Context("yarn")), Session()):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            se.checkpoint_dir(s)
        assert not s.conf
    assert se.checkpoint_dir(Session(spark_checkpoint_dir="s3a://bucket/x")) == "s3a://bucket/x"
    local = Session(Context("local[4]"))
    assert se.checkpoint_dir(local) == local.conf["spark.checkpoint.dir"]


def test_a_missing_library_leaves_the_other_queries(monkeypatch):
    real = builtins.__import__

    def without(name, *args, **kw):
        if name.startswith("cohortflow.llm"):
            raise ModuleNotFoundError("No module named 'tokenizers'", name="tokenizers")
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", without)
    with pytest.warns(UserWarning, match="tokenizers"):
        names = set(E.queries())
    assert "retention_cube" in names and not any(n.startswith("op") for n in names)

    def absent(name, *args, **kw):
        if name.startswith("cohortflow.llm"):
            raise ModuleNotFoundError("No module named 'cohortflow.llm'", name="cohortflow.llm")
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", absent)
    assert set(E.queries()) == names
