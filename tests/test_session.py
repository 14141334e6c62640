import pytest

from quire import session


class _Session:
    def __init__(self, master: str, folder: str | None) -> None:
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})


def test_a_cluster_must_name_its_folder():
    assert session.shared_folder(_Session("spark://host:7077", "hdfs:///x/")) == "hdfs:///x"
    assert session.shared_folder(_Session("local[2]", None)) == session.LOCAL_CHECKPOINTS
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            session.shared_folder(_Session(master, None))
