"""User-defined aggregates equal the built-in ones they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from tessellary.operators import aggregates


@pytest.fixture
def rows(spark):
    rng = random.Random(1)
    keys = [None, "a", "b", "hot", "hot", "hot"]
    data = [(rng.choice(keys), rng.randint(0, 2), rng.choice([None, 1.5, 2.0, 7.25]), rng.randint(1, 50), "x") for _ in range(800)] + [("empty", 0, None, 3, "x")]
    return spark.createDataFrame(data, "k string, j int, x double, n long, __states string")


def test_results_are_those_of_builtins(rows):
    wanted = {"v": aggregates.variance("x"), "g": aggregates.geometric_mean("n"), "t": aggregates.top("n", 4)}
    got = {(r.k, r.j): (r.v, r.g, r.t) for r in aggregates.aggregated(rows.repartition(7), ["k", "j"], wanted).collect()}
    top = F.slice(F.sort_array(F.collect_set("n"), asc=False), 1, 4)
    builtin = rows.groupBy("k", "j").agg(F.var_pop("x").alias("v"), F.exp(F.avg(F.log("n"))).alias("g"), top.alias("t")).collect()
    assert len(got) == len(builtin)
    for r in builtin:
        v, g, t = got[r.k, r.j]
        assert (v is None) == (r.v is None) and (v is None or v == pytest.approx(r.v)) and g == pytest.approx(r.g) and t == r.t


def test_without_keys_and_without_rows(rows):
    wanted = {"v": aggregates.variance("x"), "x": aggregates.top("n", 1)}
    (one,) = aggregates.aggregated(rows.repartition(5), [], wanted).collect()
    assert (one.v, one.x) == (pytest.approx(rows.agg(F.var_pop("x")).first()[0]), [50])
    assert aggregates.aggregated(rows.where("false"), ["k"], wanted).collect() == []


def test_tables_of_states_merge_in_rounds(rows, monkeypatch):
    monkeypatch.setattr(aggregates, "FAN", 2)
    got = {r.k: r.t for r in aggregates.aggregated(rows.repartition(9), ["k"], {"t": aggregates.top("n", 2)}).collect()}
    assert got == {r.k: r.t for r in rows.groupBy("k").agg(F.slice(F.sort_array(F.collect_set("n"), asc=False), 1, 2).alias("t")).collect()}
