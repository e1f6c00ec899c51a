from types import SimpleNamespace

import pytest

from edgeproof.plans.cut import fresh_path


def session(master, folder):
    values = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": "/w"}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: values[k] or d), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_must_name_its_shared_folder():
    assert fresh_path(session("local[4]", None), "x").startswith("/w/_shared/edgeproof/x-")
    assert fresh_path(session("spark://a:7077", "/shared"), "x").startswith("/shared/edgeproof/x-")
    for master in ("spark://a:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            fresh_path(session(master, None), "x")
