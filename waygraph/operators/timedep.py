"""Travel times that depend on the time of day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygraph.functions.order import running_total
from waygraph.loop import materialise, release
from waygraph.operators.paths import _loop
from waygraph.tables import Graph

#: The weekday curve's multipliers from midnight on, hour by hour.
WEEKDAY = (
    1.00, 1.00, 1.00, 1.00, 1.02, 1.10, 1.35, 1.80, 2.35, 2.55, 2.05, 1.70,
    1.55, 1.55, 1.50, 1.60, 1.85, 2.30, 2.60, 2.40, 1.90, 1.50, 1.25, 1.08,
)
TIERS = 5
SPEED, SEED = 11.1, 271828
DAY, GUARD = 86_400.0, 60.0
#: A search between two nodes first takes arcs up to this share's time, and doubles it until both sides meet; above WIDE times the slowest arc it takes all.
SHORT, WIDE = 0.05, 1024


def congestion_tiers(edges: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds to edges(eid, w) the tier 0 to 4: the share of longer roads, moved by -1, 0 or 1 by a linear congruence on the id.

    The order is by (w, eid), which are distinct; only the rows at which a fifth begins are looked for, exactly, so edges are not sorted.
    """
    jitter = F.expr(f"(((eid % 2147483647) * 1103515245 + {seed}) div 65536) % 3 - 1")
    fifth = sum((F.coalesce(F.struct("w", "eid") >= F.get("_firsts", F.lit(k)), F.lit(False)).cast("int") for k in range(TIERS - 1)), F.lit(0))
    tier = F.greatest(F.lit(0), F.least(F.lit(TIERS - 1), fifth + jitter))
    return edges.crossJoin(F.broadcast(_fifths(edges))).withColumn("tier", tier.cast("int")).drop("_firsts")  # one row


def _fifths(edges: DataFrame) -> DataFrame:
    """One row (_firsts): the (w, eid) at which the second and later of TIERS equal shares of edges(eid, w) begin.

    Weights are counted first; only edges of the weights at which a share begins are put in order by eid.
    """
    sizes = materialise(edges.groupBy("w").agg(F.count("*").alias("n")), "weights")
    share = F.explode(F.array(*map(F.lit, range(1, TIERS)))).alias("share")
    begins = sizes.agg(F.sum("n").alias("m")).select(share, "m").select(F.ceil(F.col("m") * F.col("share") / TIERS).alias("begins"))
    at = running_total(sizes, "w", F.col("n"), "before").join(F.broadcast(begins), (F.col("before") <= F.col("begins")) & (F.col("begins") < F.col("before") + F.col("n")))
    at = materialise(at.select(F.col("w").alias("at"), "begins", "before"), "fifths")  # TIERS - 1 rows at most
    of = edges.select("w", "eid").join(F.broadcast(at.groupBy("at").agg(F.min("before").alias("before"))), F.col("w").eqNullSafe(F.col("at")))
    ranked = running_total(of.withColumn("_order", F.struct("w", "eid")), "_order", F.lit(1).cast("long"), "k")
    # what lies before a row: all of lesser weights, its own weight's by eid; k counts those of the lesser weights in `at` too
    start = ranked.groupBy("at").agg(F.min("k").alias("start")).withColumnRenamed("at", "own")
    ranked = ranked.join(F.broadcast(start), F.col("at").eqNullSafe(F.col("own"))).select("w", "eid", (F.col("before") + F.col("k") - F.col("start")).alias("rank"))
    firsts = ranked.join(F.broadcast(at.select("begins")), F.col("rank") == F.col("begins"))
    return materialise(firsts.agg(F.sort_array(F.collect_list(F.struct("w", "eid"))).alias("_firsts")), "firsts")


def multiplier(tier: Column, seconds: Column) -> Column:
    """The curve between two hours, by the tier's share of it (tier 0 flows freely), at seconds after midnight, day after day."""
    curve = F.array(*map(F.lit, WEEKDAY))
    hour = F.pmod(seconds, F.lit(DAY)) / 3600
    low = F.floor(hour).cast("int")
    a, b = F.get(curve, low), F.get(curve, F.pmod(low + 1, F.lit(24)))
    return 1 + tier / (TIERS - 1) * (a + (b - a) * (hour - low) - 1)


def travel_time(w: Column, tier: Column, seconds: Column, speed: float = SPEED) -> Column:
    return w / (speed if speed > 0 else SPEED) * multiplier(tier, seconds)


def congestion_range(tier: Column) -> Column:
    """How many times its quickest hour an arc of this tier takes in its slowest; 1 if it never takes any."""
    hours = [1 + tier / (TIERS - 1) * (c - 1) for c in (min(WEEKDAY), max(WEEKDAY))]
    low, high = F.least(*hours), F.greatest(*hours)
    return F.when(low > 0, high / low).otherwise(F.lit(1.0))


def arrival(w: Column, tier: Column, seconds: Column, speed: float = SPEED) -> Column:
    """Arrival time; who leaves later doesn't arrive before one who left a minute earlier."""
    before = seconds - GUARD
    return F.greatest(seconds + travel_time(w, tier, seconds, speed), before + travel_time(w, tier, before, speed))


def earliest_arrivals(graph: Graph, starts: DataFrame, speed: float = SPEED, max_rounds: int = 10_000, target: int | None = None) -> DataFrame:
    """(dep, id, arrival) for starts(dep, id), in seconds: all departures in one loop. graph.edges has eid or gets none twice.

    With a target only its arrival is sure to be the earliest: labels that are not before the best known there go no further.
    """

    def bound(front: DataFrame, state: DataFrame) -> DataFrame:
        best = state.where(F.col("id") == target).select("dep", F.col("d").alias("best"))
        return front.join(best, "dep", "left").where(F.col("best").isNull() | (F.col("d") < F.col("best"))).select("dep", "id", "d")

    edges = graph.edges if "tier" in graph.edges.columns else congestion_tiers(graph.edges, SEED)
    labels, _ = _loop(
        edges.select("src", "dst", "w", "tier"), starts.select("dep", "id", F.col("dep").alias("d")),
        arrival(F.col("w"), F.col("tier"), F.col("d"), speed), max_rounds, None if target is None else bound, keys=("dep", "id"),
    )
    return labels.select("dep", "id", F.col("d").alias("arrival"))


def journeys(graph: Graph, starts: DataFrame, speed: float = SPEED, max_rounds: int = 10_000) -> DataFrame:
    """(dep, id, duration, metres, free_flow) for starts(dep, id): of the earliest arrivals the shortest way, and its seconds on empty roads."""
    edges = graph.edges if "tier" in graph.edges.columns else congestion_tiers(graph.edges, SEED)
    label = F.struct(arrival(F.col("w"), F.col("tier"), F.col("d.at"), speed).alias("at"), (F.col("d.metres") + F.col("w")).alias("metres"))
    start = starts.select("dep", "id", F.struct(F.col("dep").alias("at"), F.lit(0.0).alias("metres")).alias("d"))
    labels, _ = _loop(edges.select("src", "dst", "w", "tier"), start, label, max_rounds, keys=("dep", "id"))
    free = F.col("d.metres") / (speed if speed > 0 else SPEED)
    return labels.select("dep", "id", (F.col("d.at") - F.col("dep")).alias("duration"), F.col("d.metres").alias("metres"), free.alias("free_flow"))


def _balls(arcs: DataFrame, labels: DataFrame, reach: float, known: float) -> DataFrame:
    """The labels (side, slow, id, d) with those that are within `reach` of either end, exactly: least seconds at the quickest hours, and at the slowest.

    Labels up to `known` have been searched on over these arcs. Fronts are short, so arcs are read where they lie.
    """
    keys = ["side", "slow", "id"]
    d = F.col("d") + F.when(F.col("slow"), F.col("most")).otherwise(F.col("least"))
    step = lambda front, side, here, there: front.where(F.col("side") == side).drop("id").join(arcs, F.col("_at") == F.col(here)).select("side", "slow", F.col(there).alias("id"), d.alias("d"))
    front = labels.where(F.col("d") > known)
    while True:
        # as a table of its own, whose size says how to join it
        front = materialise(front.where(F.col("d") <= reach).select(*keys, "d", F.col("id").alias("_at")), "front")
        if front.isEmpty():
            return labels
        found = step(front, 0, "src", "dst").unionByName(step(front, 1, "dst", "src")).groupBy(*keys).agg(F.min("d").alias("d"))
        both = labels.select(*keys, "d", F.col("d").alias("old")).unionByName(found.withColumn("old", F.lit(None).cast("double")))
        best = both.groupBy(*keys).agg(F.min("d").alias("d"), F.min("old").alias("old"))
        after = materialise(best.select(*keys, "d", (F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("new")), "balls")
        for done in (labels, front):
            release(done)
        labels, front = after, after.where("new")


def _between(edges: DataFrame, source: int, target: int, speed: float, within: float | None = None) -> tuple[DataFrame, float]:
    """The edges(src, dst, w, tier) that journeys of at most `within` seconds can take, and those seconds.

    Without `within` it is what the best way takes that meets nothing but the slowest hours, so that the quickest journey
    of any departure is among them. Half the seconds are searched from either end, over arcs that are no longer than the
    whole; that starts with few short arcs and widens until both sides meet. Without a path there are no edges.
    """
    free = F.col("w") / (speed if speed > 0 else SPEED)
    # least holds for all tiers, so that arcs that are too long are left out before theirs is worked out
    least = free * min(1.0, *WEEKDAY)
    most = free * F.greatest(F.lit(1.0), 1 + F.col("tier") / (TIERS - 1) * (max(WEEKDAY) - 1))
    timed = edges.select("src", "dst", "w", "tier", least.alias("least"), most.alias("most"))
    some = timed.agg(F.percentile_approx("least", SHORT, 1000).alias("short"), F.avg("least").alias("mean"), F.max("least").alias("top")).first()
    radius = within if within is not None else next((x for x in (some["short"], some["mean"]) if x and x > 0), some["top"])
    ends = edges.sparkSession.range(4).select(  # either end, twice
        (F.col("id") % 2).cast("int").alias("side"), (F.col("id") > 1).alias("slow"),
        F.when(F.col("id") % 2 == 0, F.lit(source)).otherwise(F.lit(target)).cast("long").alias("id"), F.lit(0.0).alias("d"))
    labels = materialise(ends, "balls")
    part = lambda side, slow, id_, d: labels.where((F.col("side") == side) & (F.col("slow") == slow)).select(F.col("id").alias(id_), F.col("d").alias(d))
    while radius is not None:
        arcs, known = materialise(timed.where(F.col("least") <= radius), "arcs"), -1.0
        for reach in (radius / 8**0.5, radius / 2):
            labels, known = _balls(arcs, labels, reach, known), reach
            if within is None:
                met = part(0, True, "id", "a").join(part(1, True, "id", "b"), "id").agg(F.min(F.col("a") + F.col("b"))).first()[0]
                within = None if met is None else met * (1 + 1e-9) + 1e-6
            if within is not None and within <= 2 * reach:
                # outside of a ball there are more than `reach` seconds left; where both ends are, no journey is quick enough
                away, home = part(0, False, "src", "f").where(F.col("f") <= reach), part(1, False, "dst", "b").where(F.col("b") <= reach)
                whole = F.coalesce("f", F.lit(reach)) + F.col("least") + F.coalesce("b", F.lit(reach))
                near = arcs.join(away, "src", "left").join(home, "dst", "left").where(F.coalesce("f", "b").isNotNull() & (whole <= within))
                near = materialise(near.select("src", "dst", "w", "tier"), "near")
                release(arcs)
                return near, within
        release(arcs)
        if within is not None:
            radius = within
        elif radius == float("inf") or (some["top"] <= radius and labels.where((F.col("d") > reach) & ~F.col("slow")).select("side").distinct().count() < 2):
            break  # one side has been searched to its end
        else:
            radius = 2 * radius if radius < WIDE * some["top"] else float("inf")
    return edges.select("src", "dst", "w", "tier").where(F.lit(False)), float("inf")


def scan_departures(graph: Graph, source: int, target: int, samples: int = 24, speed: float = SPEED) -> DataFrame:
    """Durations (dep, duration, best, worst) of evenly spaced departures over a day; first wins ties."""
    n = max(2, samples)
    deps = graph.nodes.sparkSession.range(n).select((F.col("id") * (DAY / n)).alias("dep"), F.lit(source).cast("long").alias("id"))
    edges = graph.edges if "tier" in graph.edges.columns else congestion_tiers(graph.edges, SEED)
    within, longest = None, float("inf")
    while within is None or longest > within:  # more than once only where long arcs let overtake
        near, within = _between(edges, source, target, speed, None if within is None else longest)
        labels = earliest_arrivals(Graph(graph.nodes, near), deps, speed, target=target).where(F.col("id") == target)
        found = materialise(labels.select("dep", (F.col("arrival") - F.col("dep")).alias("duration")), "durations")
        longest = found.agg(F.coalesce(F.max("duration"), F.lit(0.0))).first()[0]
    out = deps.select("dep").join(found, "dep", "left")
    ends = out.agg(F.min_by("dep", F.struct("duration", "dep")).alias("b"), F.max_by("dep", F.struct("duration", -F.col("dep"))).alias("m"))
    return out.crossJoin(ends).select("dep", "duration", (F.col("dep") == F.col("b")).alias("best"), (F.col("dep") == F.col("m")).alias("worst"))
