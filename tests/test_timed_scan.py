"""Scans of departures search between both ends, over the edges that can matter."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from waygraph.operators import timedep
from waygraph.tables import Graph


def timed(spark, arcs):
    edges = spark.createDataFrame(arcs, "src long, dst long, w double, tier int")
    return Graph(edges.select(F.col("src").alias("id")).distinct(), edges)


def seconds(w, tier, at):
    hour = at % 86_400 / 3600
    a, b = timedep.WEEKDAY[int(hour)], timedep.WEEKDAY[(int(hour) + 1) % 24]
    return w / timedep.SPEED * (1 + tier / 4 * (a + (b - a) * (hour - int(hour)) - 1))


def quickest(arcs, source, target, dep):
    best, waits = {}, [(dep, source)]
    while waits:
        d, at = heapq.heappop(waits)
        if at in best:
            continue
        best[at] = d
        for s, t, w, tier in arcs:
            if s == at and w is not None:
                heapq.heappush(waits, (max(d + seconds(w, tier, d), d - 60 + seconds(w, tier, d - 60)), t))
    return best[target] - dep if target in best else None


@pytest.mark.parametrize("scale, source, target", [(40.0, 0, 17), (900.0, 3, 29), (40.0, 0, 99), (40.0, 5, 5)])
def test_scans_find_the_quickest_of_all_ways(spark, scale, source, target):
    draw = random.Random(scale + source)
    arcs = [(draw.randrange(40), draw.randrange(40), draw.choice([0, 1, 2, 5, 9, 50]) * scale, draw.randrange(5)) for _ in range(160)]
    arcs += [(98, 99, 1.0, 0), (source, target, None, 0)]
    found = {r["dep"]: r["duration"] for r in timedep.scan_departures(timed(spark, arcs), source, target, samples=8).collect()}
    want = {k * 10_800.0: quickest(arcs, source, target, k * 10_800.0) for k in range(8)}
    assert found.keys() == want.keys() and (target in (99, 5)) == all(x in (None, 0) for x in want.values())
    for dep, x in want.items():
        assert found[dep] is None if x is None else found[dep] == pytest.approx(x, abs=1e-6)


def test_only_edges_that_can_matter_are_dealt(spark, monkeypatch):
    """Neither what lies far off nor what no way leads to."""
    chain = [(k, k + 1, 10.0, k % 5) for k in range(90)]
    aside = [(1000 + k, 1001 + k, float(k % 30), 2) for k in range(500)]
    dealt, loop = [], timedep._loop
    monkeypatch.setattr(timedep, "_loop", lambda e, *a, **b: (dealt.append(e.count()), loop(e, *a, **b))[1])
    found = timedep.scan_departures(timed(spark, chain + aside), 40, 44, samples=2).collect()
    assert [r["duration"] for r in found] == [pytest.approx(quickest(chain, 40, 44, r["dep"])) for r in found]
    assert len(dealt) == 1 and 4 <= dealt[0] <= 12


def test_timed_pairs_are_written_once_for_both_ways(spark, monkeypatch):
    from waygraph.plans import derive, queries

    written, write = {}, queries.materialise
    monkeypatch.setattr(queries, "materialise", lambda df, name="step": written.setdefault(name, write(df, name)))
    got = queries._timed_supplier_part(spark, "/root/testdata/sf0.001").edges.select("src", "dst", "w").collect()
    want = derive.supplier_part(spark, "/root/testdata/sf0.001").edges.select("src", "dst", F.col("w") * 40).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert sum(df.count() for df in written.values()) * 2 == len(got)
