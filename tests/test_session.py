"""Where intermediate tables may lie, and what goes into them."""

import pytest

from revmill import session
from revmill.plans import inputs, queries


class Context:
    def __init__(self, master):
        self.master = master
        self.dir = None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


class Session:
    def __init__(self, master, root=None):
        self.sparkContext = Context(master)
        self.conf = {"spark.checkpoint.dir": root}


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_root(Session("spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_root(Session("local-cluster[2,1,1024]"))
    assert session.shared_root(Session("spark://host:7077", "hdfs://shared")) == "hdfs://shared"
    assert session.shared_root(Session("local[4]"))


def test_sizes_of_rotations_store_no_text(spark, monkeypatch):
    written = []

    def spy(df, name):
        written.append(df.columns)
        return session.stored(df, name)

    monkeypatch.setattr(inputs, "stored", spy)
    queries.QUERIES["rotation_meta"](spark, "/root/testdata/sf0.001")
    assert written and all("text" not in columns for columns in written)
