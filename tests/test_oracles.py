"""Registered queries, the readers' among them, against their SQL oracles on the smallest driver tables."""

from __future__ import annotations

import os

import pytest
from check_oracles import compare, connect
from tallyloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracles())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_oracle(spark, con, name):
    frame = catalog.queries()[name](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert compare(spark, con, lambda *_: frame, catalog.oracles()[name], SF) is None
