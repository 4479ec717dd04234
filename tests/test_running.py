"""Statistics of prefixes: a prefix's mean is computed once, not again for each element."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from taqlspark.engine import taql

LONG = [float(x) for x in np.random.default_rng(7).normal(50.0, 9.0, 1000)]

#: Each name and its statistic of a prefix.
RUNNING = {
    "BOXEDAVDEV": lambda p: np.abs(p - p.mean()).mean(),
    "BOXEDSAMPLESTDDEV": lambda p: p.std(ddof=1) if len(p) > 1 else 0.0,
    "BOXEDSAMPLEVARIANCE": lambda p: p.var(ddof=1) if len(p) > 1 else 0.0,
    "BOXEDVARIANCE": lambda p: p.var(),
    "RUNNINGAVDEV": lambda p: np.abs(p - p.mean()).mean(),
    "RUNNINGSAMPLESTDDEV": lambda p: p.std(ddof=1) if len(p) > 1 else 0.0,
    "RUNNINGSAMPLEVARIANCE": lambda p: p.var(ddof=1) if len(p) > 1 else 0.0,
    "RUNNINGSTDDEV": lambda p: p.std(),
}


@pytest.mark.parametrize("name", RUNNING)
def test_running_over_a_long_array(spark, name):
    """With the mean inside the loop over the elements, this takes minutes."""
    table = spark.range(1).select(F.lit(LONG).alias("a"))
    taql(spark, f"SELECT {name}(a) AS v FROM $1", [spark.range(1).select(F.lit(LONG[:3]).alias("a"))]).collect()  # starts the session
    began = time.time()
    [(got,)] = taql(spark, f"SELECT {name}(a) AS v FROM $1", [table]).collect()
    assert time.time() - began < 20
    assert np.allclose(got, [RUNNING[name](np.array(LONG[: k + 1])) for k in range(len(LONG))], rtol=1e-12, atol=0)


def test_an_index_takes_one_prefix(spark):
    """An index into a running statistic computes that prefix only; places outside are zero."""
    table = spark.range(1).select(F.array(*map(F.lit, [1.0, 3.0, 8.0])).alias("a"))
    places = {0: 0.0, 1: 2.0, 2: 13.0, 3: 0.0, -1: 13.0, -2: 2.0, -4: 0.0}
    found = taql(spark, f"SELECT {', '.join(f'RUNNINGSAMPLEVARIANCE(a)[{k}] AS v{i}' for i, k in enumerate(places))} FROM $1", [table])
    assert np.allclose(found.collect()[0], list(places.values()))
    assert "sequence" not in found._jdf.queryExecution().analyzed().toString()
