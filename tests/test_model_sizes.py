from __future__ import annotations

import inspect

from skysieve import contracts as C
from skysieve.operators import learning as M
from skysieve.plans import learning_queries as Q


def test_registered_models_have_the_default_sizes():
    assert [Q.TREES, Q.NETWORK, Q.MIXTURE] == [M.ModelSpec(kind) for kind in ("boosted_trees", "network", "mixture")]
    assert Q.PROTOCOL == C.Protocol()
    source = inspect.getsource(Q)
    assert "folds=" not in source and "iterations=" not in source
