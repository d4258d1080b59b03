"""Properties on random data: hot keys, gaps, resampling, counting shortcuts - against plain Python."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trapline.functions import resampling
from trapline.functions.ordered import positions, ranked
from trapline.functions.pairing import with_every
from trapline.functions.resampling import member_counts, mixed, slice_sizes
from trapline.operators import activity as A
from trapline.operators import curves as D
from trapline.operators import filters as L
from trapline.operators import occurrences as X
from trapline.operators import reports as R
from trapline.operators import sessions as G

START = dt.datetime(2024, 3, 1)


def shots(seed, rows=600, keys=4, span=400_000):
    """Photos of which one key holds about a third, with equal times, sub-second times and runs over midnight."""
    rng = random.Random(seed)
    result = []
    for n in range(rows):
        key = 0 if rng.random() < 0.34 else rng.randrange(keys)
        second = rng.choice((rng.randrange(span), 86_390 + rng.randrange(20), rng.randrange(300) * 60))
        result.append((n, f"k{key}", START + dt.timedelta(seconds=second, microseconds=rng.choice((0, 0, 250_000)))))
    return result


def plain_sessions(rows, gap):
    by_key, found = defaultdict(list), {}
    for n, key, at in rows:
        by_key[key].append((at, n))
    for key, items in by_key.items():
        items.sort()
        index = place = 0
        previous = None
        for at, n in items:
            if previous is None or (at - previous).total_seconds() > gap:
                index, place = index + 1, 0
            place += 1
            found[n] = (key, index, place)
            previous = at
    return found


@pytest.mark.parametrize("seed, gap", [(1, 60), (2, 3600), (3, 1), (4, 100_000)])
def test_sessions_against_a_plain_loop(spark, seed, gap):
    rows = shots(seed)
    photos = spark.createDataFrame(rows, "id long, upload_batch_id string, captured_at timestamp_ntz")
    expected = plain_sessions(rows, gap)
    found = {r.id: (r.upload_batch_id, r.series_idx, r.sequence_number) for r in G.sessionise(photos, gap_seconds=gap).collect()}
    assert found == expected
    table = G.series_table(photos, gap_seconds=gap)
    assert table.count() == len({v[:2] for v in expected.values()})
    assert table.agg(F.sum("photo_count")).first()[0] == len(rows)


def test_positions_and_neighbours(spark):
    rows = shots(9)
    frame = spark.createDataFrame(rows, "id long, k string, at timestamp_ntz")
    order = defaultdict(list)
    for n, key, at in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        order[key].append(n)
    expected = {n: i + 1 for items in order.values() for i, n in enumerate(items)}
    assert {r.id: r.position for r in positions(frame, ["k"], "at", "id").collect()} == expected
    photos = frame.select("id", F.expr("CAST(substring(k, 2) AS BIGINT)").alias("observation_id"), F.col("at").alias("captured_at"))
    shown = {r.id: (r.photo_index + 1, r.previous_id, r.next_id) for r in L.series_positions(photos).collect()}
    beside = {}
    for items in order.values():
        for before, n, after in zip([None, *items], items, [*items[1:], None]):
            beside[n] = (expected[n], before, after)
    assert shown == beside
    ids = spark.createDataFrame([(n * 7919, "k0" if n % 3 == 0 else f"k{n % 5}") for n in range(500)], "id long, k string")
    placed = ranked(ids, ["k"], ["id"], "place").collect()
    by_key = defaultdict(list)
    for r in placed:
        by_key[r.k].append((r.id, r.place))
    assert all([p for _, p in sorted(v)] == list(range(1, len(v) + 1)) for v in by_key.values())


@pytest.mark.parametrize("minutes", [1, 10, 60])
def test_events_keep_the_best_record(spark, minutes):
    rng = random.Random(minutes)
    rows = [(n, key, "site", at, rng.choice((None, 1, 2, 3))) for n, key, at in shots(minutes, 400)]
    records = spark.createDataFrame(rows, "observation_id long, scientific_name string, location_name string, series_start_time timestamp_ntz, max_quantity int")
    groups = plain_sessions([(r[0], r[1], r[3]) for r in rows], minutes * 60)
    best = {}
    for n, key, _, at, quantity in rows:
        rank = (quantity is not None, -(quantity or 0), at, n)
        event = groups[n][:2]
        best[event] = min(best.get(event, (rank, n)), (rank, n))
    assert {r.observation_id for r in X.best_of_event(records, minutes).collect()} == {n for _, n in best.values()}


def test_effort_is_at_most_the_span(spark):
    rng = random.Random(5)
    days = {(site, dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(500))) for site in range(6) for _ in range(40)}
    found = {r.location_id: r.effort_days for r in A.effort_by_location(spark.createDataFrame(sorted(days), "location_id int, day date")).collect()}
    for site in range(6):
        own = sorted(d for s, d in days if s == site)
        expected = 1 + sum(step if (step := (b - a).days) <= 15 else 1 for a, b in zip(own, own[1:]))
        assert found[site] == expected <= (own[-1] - own[0]).days + 1


def test_running_counts_equal_the_interval_join(spark):
    rng = random.Random(6)
    day = lambda n: None if n is None else dt.date(2020, 1, 1) + dt.timedelta(days=n)
    deployments = [(n, rng.choice((1, 2, None)), day(rng.choice((None, rng.randrange(60)))), day(rng.choice((None, rng.randrange(60))))) for n in range(80)]
    photos = [(n, n % 5, START.replace(year=2020, month=1, day=1) + dt.timedelta(hours=rng.randrange(1500))) for n in range(400)]
    sites = [(n, 1 if n < 3 else 2) for n in range(5)]
    found = {
        r.id: r.photo_count
        for r in R.deployment_photo_counts(
            spark.createDataFrame(deployments, "id int, location_id int, start_date date, end_date date"),
            spark.createDataFrame(photos, "id long, observation_id long, captured_at timestamp_ntz"),
            spark.createDataFrame(sites, "id long, location_id int"),
        ).collect()
    }
    where = dict(sites)
    for n, site, first, last in deployments:
        inside = [p for p in photos if where[p[1]] == site and (first is None or p[2].date() >= first) and (last is None or p[2].date() <= last)]
        assert found[n] == len(inside)


def test_every_pair_once(spark):
    left, right = spark.range(13).withColumnRenamed("id", "a"), spark.range(29).withColumnRenamed("id", "b")
    pairs = [(r.a, r.b) for r in with_every(left, right).collect()]
    assert len(pairs) == len(set(pairs)) == 13 * 29


def plain_draws(key, iteration, n, width):
    """The members that a sample of n out of n members draws, slice by slice."""
    number = lambda k, d, seed: int(mixed(k, np.array([iteration]), np.array([d]), seed)[0])
    sizes = [n] if n <= width else [0] * -(-n // width)
    for d in range(n if len(sizes) > 1 else 0):
        sizes[number(key, d, 1 + resampling.SLICE_SEED) % n // width] += 1
    out = []
    for s, size in enumerate(sizes):
        members = min(width, n - s * width)
        out += [s * width + number(key + resampling.SLICE_KEY * s, d, 1) % members for d in range(size)]
    return out


def sampled(key, iterations, n, width, places):
    """Counts of all members, worked out slice by slice from ranges of places."""
    sizes = sum(slice_sizes(key, iterations, n, 1, low, min(low + places, n), width) for low in range(0, n, places)) if n > width else np.full((len(iterations), 1), n)
    return np.hstack([member_counts(key, iterations, sizes[:, s], s, min(width, n - s * width), 1) for s in range(sizes.shape[1])])


@pytest.mark.parametrize("width", [20, 6])
def test_draws_are_uniform_in_one_slice_and_in_many(width):
    drawn = sampled(12345, np.arange(4000), 20, width, 7)
    assert (drawn.sum(axis=1) == 20).all()
    expected = drawn.sum() / 20
    chi = ((drawn.sum(axis=0) - expected) ** 2 / expected).sum() / 19
    assert 0.4 < chi < 2.0
    means = (drawn * np.arange(20)).sum(axis=1) / 20
    assert means.std() == pytest.approx(np.sqrt((20**2 - 1) / 12 / 20), rel=0.05)
    pairs = np.corrcoef(drawn.T) + np.eye(20) * (-1 / 19 - 1)  # counts of two members lean apart by 1/19
    assert np.abs(pairs + 1 / 19).max() < 0.08
    for i in (0, 7, 3999):
        assert np.bincount(plain_draws(12345, i, 20, width), minlength=20).tolist() == drawn[i].tolist()


def test_work_of_draws_is_linear_in_the_sites(monkeypatch):
    """Numbers made for a sample of one iteration: two for each place, whatever the number of slices."""
    made = []
    monkeypatch.setattr(resampling, "mixed", lambda *a: made.append(np.broadcast_shapes(np.shape(a[1]), np.shape(a[2]))) or mixed(*a))
    for n in (2_000, 20_000, 200_000):
        made.clear()
        counts = sampled(99, np.arange(3), n, resampling.SLICE, resampling.PLACES)
        assert counts.shape == (3, n) and (counts.sum(axis=1) == n).all()
        assert sum(int(np.prod(s)) for s in made) == 3 * n * (2 if n > resampling.SLICE else 1)


def test_years_of_many_slices_against_plain_python(spark, monkeypatch):
    import hashlib

    from trapline.operators import trends as T

    rng = random.Random(8)
    rows = [(sp, site, 2000 + k % 3, rng.randrange(5), rng.randrange(1, 30)) for sp in (1, 2, 40) for site in range(11) for k in range(3) if rng.random() < 0.9]
    yearly = spark.createDataFrame(rows, "species_id long, location_id int, year int, detections long, trap_days long")
    scopes = spark.createDataFrame([("global", "", site) for site in range(12)] + [("part", "x", site) for site in (9, 2, 4, 7)], "scope_type string, scope_id string, location_id int")
    monkeypatch.setattr(resampling, "PLACES", 4)
    for name, value in (("SLICE", 3), ("ITERATION_BLOCK", 5), ("SPECIES_TOGETHER", 2)):
        monkeypatch.setattr(T, name, value)
    found = {}
    for r in T.resampled_years(yearly, scopes, 12).collect():
        for i, sums in enumerate(zip(r.detections, r.trap_days)):
            found[r.species_id, r.scope_type, 5 * r.block + i, r.year] = sums
    expected = defaultdict(lambda: [0, 0])
    for kind, name, sites in (("global", "", list(range(11))), ("part", "x", [2, 4, 7, 9])):
        key = int(hashlib.md5(f"{kind}|{name}".encode()).hexdigest()[:7], 16)
        inside = {(sp, y) for sp, site, y, _, _ in rows if site in sites}
        for i in range(12):
            picks = plain_draws(key, i, len(sites), 3)
            for sp, year in inside:
                expected[sp, kind, i, year] = [0, 0]
            for pick in picks:
                for sp, site, year, det, trap in rows:
                    if site == sites[pick]:
                        expected[sp, kind, i, year][0] += det
                        expected[sp, kind, i, year][1] += trap
    whole = {k: v for k, v in found.items() if any(v)}
    assert {k: list(v) for k, v in whole.items()} == {k: v for k, v in expected.items() if any(v)}


def test_overlap_matrix_is_symmetric(survey):
    from trapline.plans.statistics_queries import _times

    rows = D.overlap_matrix(D.activity_curve(_times(survey), "percent", 0.25)).collect()
    values = {(r.species_a, r.species_b): r.mean for r in rows}
    for (a, b), value in values.items():
        assert value == values[b, a] and -1e-9 <= value <= 1 + 1e-9
        assert a != b or value == 1.0


def test_zero_filled_activity_is_complete(survey):
    from trapline.plans.report_queries import activity

    facts = activity(survey)
    months = facts.select("location_id", "year", "month").distinct().count()
    assert facts.count() == months * survey.species.where("id > 0").count()


@pytest.mark.parametrize("bandwidth, width", [(0.25, 2000), (0, 2000), (0.25, 2), (0, 4)])
def test_resampled_curves_against_plain_numpy(spark, monkeypatch, bandwidth, width):
    import hashlib
    import math

    monkeypatch.setattr(D, "SLICE", width)
    if width < 10:
        monkeypatch.setattr(D, "ITERATION_BLOCK", 15)
        monkeypatch.setattr(D, "TIMES_TOGETHER", 3)
    rng = random.Random(4)
    rows = [(sp, site, rng.randrange(86_400) * 1_000_000 + rng.randrange(10**6), rng.randrange(1, 4)) for sp in (1, 2) for site in range(3 * sp) for _ in range(5)]
    rows += [(1, 50, 5, 1), (3, 1, 7, 1)]  # a site with one time; a species with too few
    times = spark.createDataFrame(rows, "species_id long, location_id int, us long, n long")
    found = {(r.species_id, r.replicate, r.i): (r.points, r.value) for r in D.resampled_curves(times, bandwidth, 40).collect()}
    expected = {}
    grid = np.linspace(0, 24, 128) if bandwidth else np.arange(24)
    for species in (1, 2):
        sites = sorted({site for sp, site, _, _ in rows if sp == species})
        key = int(hashlib.md5(str(species).encode()).hexdigest()[:7], 16)
        for replicate, picks in enumerate(plain_draws(key, i, len(sites), width) for i in range(40)):
            hours = np.array([us / D.HOUR_US for p in picks for sp, site, us, n in rows if sp == species and site == sites[p] for _ in range(n)])
            if bandwidth:
                h = bandwidth * math.sqrt((3 * ((hours - hours.mean()) ** 2).sum() + 2 * 576 * len(hours)) / (3 * len(hours) - 1))
                value = sum(np.exp(-0.5 * ((grid[:, None] - hours[None, :] - shift) / h) ** 2).sum(1) for shift in (-24, 0, 24)) * 100 / (len(hours) * h * math.sqrt(2 * math.pi))
            else:
                value = np.array([(hours // 1 == g).sum() * 100 / len(hours) for g in grid])
            expected.update({(species, replicate, i): (len(hours), v) for i, v in enumerate(value)})
    assert found.keys() == expected.keys()
    assert all(found[k][0] == n and found[k][1] == pytest.approx(v, rel=1e-8, abs=1e-9) for k, (n, v) in expected.items())


def test_positions_of_a_hot_key_are_spread(spark):
    """One key holds most rows and its numbers are hashed: positions agree with a plain sort, and no task gets the key."""
    key = F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, F.concat(F.lit("k"), (F.col("id") % 7).cast("string")))
    rows = spark.range(20_000).select(key.alias("key"), F.xxhash64("id").alias("number"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = ranked(rows, ["key"], ["number"], "position", "total").withColumn("task", F.spark_partition_id())
        got = found.select("key", "number", "position", "total").toPandas()
        places = ranked(rows.where("key = 'hot'"), [], ["number"], "position").groupBy(F.floor(F.col("position") / 2000)).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    plain = rows.select("key", "number").toPandas().fillna({"key": "-"})
    plain["position"] = plain.groupby("key")["number"].rank(method="first").astype(int)
    plain["total"] = plain.groupby("key")["number"].transform("size")
    order = ["key", "number"]
    assert got.fillna({"key": "-"}).sort_values(order).values.tolist() == plain.sort_values(order).values.tolist()
    assert len(places) == 9
