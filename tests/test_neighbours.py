"""Neighbour search keeps small tables off the driver and ranks a node's distances where they were joined."""

import numpy as np

from fieldloom.operators import particles as P


def test_nothing_but_one_row_is_broadcast(spark):
    rng = np.random.default_rng(2)
    places = rng.uniform(0, 10, (400, 3))
    rows = [(i, *map(float, p)) for i, p in enumerate(places)] + [(400, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    for box in (None, 10.0):
        found = P.neighbour_h(df, 5, box=box)
        off = np.abs(places[:, None] - places[None])
        off = off if box is None else np.minimum(off, box - off)
        want = np.sqrt(np.sort((off**2).sum(axis=2), axis=1)[:, 5])
        got = dict(map(tuple, found.collect()))
        np.testing.assert_allclose([got[i] for i in range(400)], want, rtol=1e-9)
        assert got[400] == P.LONELY and len(got) == 401
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
