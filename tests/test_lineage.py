"""Cuts that a scope removes."""

import pathlib

from weftspan.functions.lineage import OWN, cut, scope, shared_folder


def test_a_scope_removes_its_own_cuts_alone(spark):
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:")) / f"{OWN}-{spark.sparkContext.applicationId}"
    outer = cut(spark.range(5))
    with scope(spark):
        inner = cut(outer.filter("id > 1"))
        assert inner.count() == 3 and len(list(folder.glob("scope-*"))) == 1
    assert not list(folder.glob("scope-*")) and outer.count() == 5
