from types import SimpleNamespace

import pytest

from skysieve.plans import registry
from skysieve.session import JIT_METHOD_LIMIT, METHOD_LIMIT, scratch_root


def fake(master, root=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: root),
        sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
    )


def test_cluster_without_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(fake("spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(fake("local-cluster[3,2,1024]"))


def test_shared_folder_wins_and_local_mode_may_make_one():
    assert scratch_root(fake("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert scratch_root(fake("local[8]")).startswith("/tmp/")


def test_registered_queries_get_the_method_limit(monkeypatch):
    monkeypatch.setattr(registry, "QUERIES", {})
    registry.query("any")(lambda spark, sf: sf)
    for before, after in (({}, JIT_METHOD_LIMIT), ({METHOD_LIMIT: "20000"}, "20000")):
        session = SimpleNamespace(conf=SimpleNamespace(get=before.get, set=before.__setitem__))
        assert registry.QUERIES["any"](session, "sf") == "sf" and before == {METHOD_LIMIT: after}
