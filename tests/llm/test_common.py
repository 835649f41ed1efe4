"""Scratch tables: where they are, and that they go."""

import os
from urllib.parse import urlparse

import numpy as np
import pytest

from quillstone.llm import common
from quillstone.llm.common import local_rows
from quillstone.llm.kneser_ney import _languages


def left(spark):
    return {x for x in os.listdir(urlparse(common.shared_dir(spark)).path) if x.startswith("quillstone")}


def test_scratch_written_inside_goes_at_the_end(spark):
    before, tables = left(spark), {t.name for t in spark.catalog.listTables()}
    with common.temporary(spark):
        kept = common.materialize(spark.range(5), "test")
        common.bucketed(spark.range(5), "id", "test").collect()
        assert len(left(spark) - before) == 2 and kept.count() == 5
    assert left(spark) == before and {t.name for t in spark.catalog.listTables()} == tables


def test_it_goes_when_the_work_fails(spark):
    before = left(spark)
    with pytest.raises(ZeroDivisionError), common.temporary(spark):
        common.materialize(spark.range(5), "test")
        raise ZeroDivisionError
    assert left(spark) == before


def test_small_tables_start_no_workers_of_a_second_kind(spark, capsys):
    rows = [(1, None, 2.5), (2, "a", 0.0)]
    made = local_rows(spark, rows, "k int, name string, x double")
    assert made.schema.simpleString() == "struct<k:int,name:string,x:double>" and [tuple(r) for r in made.orderBy("k").collect()] == rows
    assert local_rows(spark, [], "k int, name string").collect() == []
    made.explain()
    vocabulary = spark.sql("SELECT array('de') AS own_names, array(5L) AS kinds")
    found = _languages(vocabulary)
    assert sorted((r["own"], r["kinds"]) for r in found.collect()) == [("", 7), ("de", 12)]
    found.explain()
    assert "ExistingRDD" not in capsys.readouterr().out


def test_a_worker_keeps_one_thing_until_another_stage():
    made = []
    for key in ("a", "a", "b"):
        made.append(common.kept((key,), lambda: np.zeros(1)))
        assert list(common._KEPT) == [(key,)]
    assert made[0] is made[1] and made[1] is not made[2]
    common.let_go()
    assert not common._KEPT
