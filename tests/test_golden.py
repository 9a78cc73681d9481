"""Cases worked out by hand, and properties."""

import math
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidejoin.functions import geo, scalars
from tidejoin.operators import joins, metrics, migration, monitor, ordered, placement
from tidejoin.plans import options
from tidejoin.sources import records, sinks
from tidejoin.streaming.engine import Engine

quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def bisect(lat, lon, p):
    code, a, b, bits = "", [-90.0, 90.0], [-180.0, 180.0], 0
    for i in range(5 * p):
        r, x = (b, lon) if i % 2 == 0 else (a, lat)
        middle = (r[0] + r[1]) / 2
        bits = bits * 2 + (x >= middle)
        r[0 if x >= middle else 1] = middle
        if i % 5 == 4:
            code, bits = code + geo.ALPHABET[bits], 0
    return code


def test_geohash(spark):
    cases = [(30.703971, 104.094640, 7, "wm6n8tr"), (30.703971, 104.094640, 1, "w"), (0, 0, 7, "s000000"), (90, 180, 7, "zzzzzzz"), (-90, -180, 7, "0000000"), (95, 200, 7, "zzzzzzz"), (42.605, -5.603, 5, "ezs42"), (1.0, 1.0, 0, "s"), (math.nan, math.nan, 3, "000")]
    assert one(spark, *(geo.encode(F.lit(float(a)), F.lit(float(b)), p).alias(f"c{i}") for i, (a, b, p, _) in enumerate(cases))) == tuple(x[3] for x in cases)
    back = [("wm6n8tr", 30.703, 104.095), ("ezs42", 42.60, -5.60), ("s000000", 0.001, 0.001)]
    got = one(spark, *(geo.decode(F.lit(h), len(h)).alias(f"c{i}") for i, (h, _, _) in enumerate(back)))
    assert [(round(r.lat, 6), round(r.lon, 6)) for r in got] == [(a, b) for _, a, b in back]
    assert one(spark, geo.decode(F.lit("WM6N8TR"), 7))[0] == one(spark, geo.decode(F.lit("0060800"), 7))[0]
    assert one(spark, geo.encode(F.lit(0.0), F.lit(0.0), 14))[0] == "00s00000000000"
    assert geo.axis_bits(7) == (17, 18) and one(spark, geo.binary(F.lit(5), 8))[0] == "00000101"
    assert one(spark, geo.describe(F.lit("s0"), 2))[0].endswith(" 10 1100000000")


@given(st.lists(st.tuples(st.integers(-90000, 90000).map(lambda x: x / 1000), st.integers(-180000, 180000).map(lambda x: x / 1000)), min_size=1, max_size=30))
@quick
def test_geohash_is_bisection(spark, points):
    rows = spark.createDataFrame(points, "lat double, lon double").select("lat", "lon", geo.encode(F.col("lat"), F.col("lon"), 7).alias("h")).collect()
    assert all(r.h == bisect(r.lat, r.lon, 7) for r in rows)


T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(ms):
    return T0 + timedelta(milliseconds=ms)


@pytest.mark.parametrize("r, s, joined", [(0, 0, True), (0, 2000, True), (0, 2001, False), (1000, 0, True), (1001, 0, False)])
@pytest.mark.parametrize("strategy", ["hash", "grouped"])
def test_window_ends_count(spark, r, s, joined, strategy):
    frame = lambda ms: spark.createDataFrame([(1, 1, at(ms))], "key long, seq long, ts timestamp")
    assert joins.join(frame(r), frame(s), window=(2.0, 1.0), strategy=strategy).count() == joined


rows = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 5000)), max_size=25)


@given(rows, rows)
@quick
def test_strategies_agree(spark, a, b):
    frame = lambda xs: spark.createDataFrame([(k, i, at(ms)) for i, (k, ms) in enumerate(xs)], "key long, seq long, ts timestamp")
    want = sorted((i, j) for i, (k, _) in enumerate(a) for j, (m, _) in enumerate(b) if k == m)
    routes = spark.createDataFrame([("R", 1, 3), ("R", 2, 0), ("S", 3, 1)], "relation string, key long, target int")
    r, s = frame(a), frame(b)
    for strategy, extra in (("hash", {}), ("hash", {"n": 4}), ("random", {}), ("random", {"small": 0}), ("grouped", {"n": 8, "m": 3}), ("routed", {"routes": routes})):
        got = joins.join(r, s, strategy=strategy, **extra)
        assert sorted((x.seq_r, x.seq_s) for x in got.select("seq_r", "seq_s").collect()) == want
    inside = sorted((i, j) for i, j in want if -500 <= b[j][1] - a[i][1] <= 900)
    for strategy in ("hash", "grouped"):
        assert sorted((x.seq_r, x.seq_s) for x in joins.join(r, s, window=(0.9, 0.5), strategy=strategy).collect()) == inside


def test_bad_options(spark):
    r = spark.createDataFrame([(1, 1)], "key long, seq long")
    for bad in ({"op": "~"}, {"strategy": "none", "n": 2}, {"strategy": "routed"}):
        with pytest.raises(ValueError):
            joins.join(r, r, **bad)


def test_group_placement(spark):
    keys = spark.range(100).withColumnRenamed("id", "key")
    visits = {}
    for r in placement.probe_grouped(keys, "key", 8, 3).collect():
        visits.setdefault(r.key, []).append(r.inst)
    assert {tuple(sorted(v)) for v in visits.values()} == {(0, 1, 2), (3, 4, 5), (6, 7)}
    stored = placement.store_grouped(keys.withColumn("id", F.col("key")), "key", "id", 8, 3).collect()
    assert all(r.inst in visits[r.key] for r in stored)
    dealt = placement.deal(placement.by_hash(keys, "key", 4), 4).withColumn("p", F.spark_partition_id())
    assert dealt.where("p <> inst").count() == 0


def test_load_and_decay(spark):
    loads = spark.createDataFrame([(0, 100, 50, 5000), (1, 20, 10, 200)], "inst int, stored long, probes long, load long")
    row = monitor.imbalance(loads).first()
    assert (row.max_inst, row.min_inst, row.imbalance) == (0, 1, 25.0)
    assert monitor.triggered(monitor.imbalance(loads)).count() == 1
    assert monitor.triggered(monitor.imbalance(loads), elapsed_ms=100).count() == monitor.triggered(monitor.imbalance(loads), 30).count() == 0
    whole = monitor.all_instances(loads, 3)
    assert monitor.imbalance(whole).first().imbalance is None and monitor.triggered(monitor.imbalance(whole)).count() == 0
    log = spark.createDataFrame([(at(0), 1, 4, 7), (at(1000), 1, 1, 0)], "at timestamp, inst int, stored long, probes long")
    for n, probes in ((1, 7), (2, 3), (3, 1), (4, 0)):
        starts = F.array(*(F.lit(at(1000 * i)) for i in range(n)))
        assert monitor.decayed(log, starts).first().probes == probes
    assert monitor.decayed(log, F.array(*(F.lit(at(1000 * i)) for i in range(4)))).first().stored == 5
    assert one(spark, monitor.parse_targets(F.lit("[1, 2]")).alias("a"), monitor.parse_targets(F.lit("[]")).alias("b")) == ([1, 2], [])


def test_greedy_plan(spark):
    keys = spark.createDataFrame([(0, "A", 40, 20), (0, "B", 30, 15), (0, "C", 20, 10), (0, "D", 10, 5), (1, "E", 20, 10)], "inst int, key string, stored long, probes long")
    loads = keys.groupBy("inst").agg(F.sum("stored").alias("stored"), F.sum("probes").alias("probes")).withColumn("load", F.col("stored") * F.col("probes"))
    ends = migration.extremes(loads)
    assert ends.first().gap == 4800
    factors = migration.factors(keys, ends)
    assert {r.key: r.factor for r in factors.collect()} == {"A": 4800, "B": 3600, "C": 2400, "D": 1200}
    assert [r.key for r in migration.greedy_plan(factors, 4800).collect()] == ["B"]
    assert migration.greedy_plan(factors, 0).count() == 0


@given(st.lists(st.integers(0, 60), max_size=40), st.integers(0, 300))
@quick
def test_greedy_plan_is_the_walk(spark, values, gap):
    keys = spark.createDataFrame([(i, f) for i, f in enumerate(values)], "key long, factor long")
    want, left = set(), gap
    for f, i in sorted(((f, i) for i, f in enumerate(values) if f > 0), key=lambda x: (-x[0], x[1])):
        if left > f:
            want.add(i)
            left -= f
    assert {r.key for r in migration.greedy_plan(keys, gap).collect()} == want


@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 30), st.integers(0, 30)), min_size=2, max_size=15))
@quick
def test_what_is_left_of_the_gap_is_the_new_gap(spark, loads):
    keys = spark.createDataFrame([(i if k > 1 else k, k, r, s) for k, (i, r, s) in enumerate(loads)], "inst int, key long, stored long, probes long")
    total = lambda rows: sorted((sum(r for _, r, _ in own) * sum(s for _, _, s in own) for own in ([x for x in rows if x[0] == i] for i in (0, 1))))
    table = keys.groupBy("inst").agg(F.sum("stored").alias("stored"), F.sum("probes").alias("probes")).withColumn("load", F.col("stored") * F.col("probes"))
    ends = migration.extremes(table)
    row, factors = ends.first(), migration.factors(keys, ends)
    plan = {r.key: r.factor for r in migration.greedy_plan(factors.select("key", "factor"), row.gap).collect()}
    after = [(row.min_inst if r.key in plan else r.inst, r.stored, r.probes) for r in keys.collect()]
    low, high = total(after)
    assert high - low == row.gap - sum(plan.values())


def test_aligned_metrics(spark):
    rows = [(5, 0, 100, 1000, 5.0), (5, 1, 60, 1000, 3.0), (6, 0, 1, 1, 1.0), (7, 0, 0, 0, 0.0), (7, 1, 0, 0, 0.0)]
    got = metrics.aligned(spark.createDataFrame(rows, "moment long, inst int, tuples long, duration long, latency double"), 2)
    got = got.withColumn("line", metrics.report_line(F.col("moment"), F.col("throughput"), F.col("mean_latency"))).orderBy("moment").collect()
    assert [(r.moment, r.throughput, r.mean_latency) for r in got] == [(5, 160.0, 0.05), (7, 0.0, 0.0)]
    assert got[0].line == "@ [5 sec], 160.00, 0.05000000"
    spaced = metrics.spaced(spark.createDataFrame([(i, i) for i in (0, 1, 2, 5, 6)], "moment long, x long"), 3).collect()
    assert sorted(r.moment for r in spaced) == [0, 5, 6]


def test_ordered_index(spark):
    index = spark.createDataFrame([(5, "a"), (3, "b"), (5, "c"), (9, "d")], "key long, value string")
    ask = lambda *ks: spark.createDataFrame([(k,) for k in ks], "key long")
    by_key = lambda frame, c: {r.key: r[c] for r in frame.collect()}
    assert ordered.size(index).first()[0] == 3 and ordered.size(index, 4, 9).first()[0] == 2
    assert by_key(ordered.get(index, ask(5, 4)), "values") == {5: ["a", "c"], 4: None}
    assert by_key(ordered.floor(index, ask(4, 2, 9, 500)), "found") == {4: 3, 2: None, 9: 9, 500: 9}
    assert by_key(ordered.ceiling(index, ask(6, 10, -300)), "found") == {6: 9, 10: None, -300: 3}
    assert by_key(ordered.rank(index, ask(5, 3, 100)), "rank") == {5: 1, 3: 0, 100: 3}
    places = spark.createDataFrame([(0,), (3,)], "rank long")
    assert {r["rank"]: r.key for r in ordered.select(index, places).collect()} == {0: 3, 3: None}
    assert [r.key for r in ordered.key_range(index, 3, 5).collect()] == [3, 5]
    pair = lambda k, v: spark.createDataFrame([(k, v)], "key long, value string")
    less = ordered.remove_values(index, pair(5, "a"))
    assert by_key(ordered.get(less, ask(5)), "values") == {5: ["c"]}
    assert ordered.size(ordered.remove_values(less, pair(5, "c"))).first()[0] == 2
    assert ordered.ends(ordered.remove_min(ordered.remove_max(index))).first() == (5, 5)
    empty = index.limit(0)
    assert ordered.is_empty(empty) and ordered.ends(empty).first() == (None, None) and ordered.remove_min(empty).count() == 0
    assert [r.value for r in ordered.in_order(index).collect()] == ["b", "a", "c", "d"]


@given(st.lists(st.integers(-50, 50), min_size=1, max_size=30))
@quick
def test_rank_and_select_undo_each_other(spark, keys):
    at = ordered.ranks(spark.createDataFrame([(k, 0) for k in keys], "key long, value long")).collect()
    assert {r.key: r["rank"] for r in at} == {k: i for i, k in enumerate(sorted(set(keys)))}


def test_scalars(spark):
    assert one(spark, scalars.to_boolean(F.lit("TRUE")), scalars.to_boolean(F.lit("yes")), scalars.to_long(F.lit("12")), scalars.to_int(F.lit(2**32 + 5)), scalars.to_int(F.lit(-1))) == (True, False, 12, 5, -1)
    assert one(spark, scalars.split_csv(F.lit("a,,b,,")), scalars.split_fields(F.lit(" a  b ")), scalars.split_fields(F.lit("a, b,c"), ",")) == (["a", "", "b"], ["a", "b"], ["a", "b,c"])
    assert scalars.field_index("s1, s2, s3, s4", "s3") == 2
    with pytest.raises(ValueError):
        scalars.field_index("s1, s2", "x")
    watch = scalars.Stopwatch(started=False)
    assert watch.elapsed() == 0 and watch.start().stop().elapsed("ns") > 0 and str(watch).split()[1] in ("ns", "µs", "ms", "s")


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("o1", "x,y,z,104.09464,30.703971"), ("o1", "short"), ("o1", "a,b,c,east,1"), ("other", "x,y,z,0,0")], "topic string, value string")
    tagged = records.tagged(rows, {"o1": "R"})
    assert [(r.relation, r.key) for r in records.geo_tuples(tagged).collect()] == [("R", "wm6n8tr")]
    assert records.malformed(tagged).first()[0] == 2
    assert records.lines(spark, str(tmp_path / "none")).count() == records.lines(spark, None).count() == 0
    path = sinks.timed_path(str(tmp_path), "out", "txt", datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("out_20240102_030405.txt")
    assert sinks.write_lines(sinks.settings_lines(spark, {"b": 1, "a": 2}), path) == path
    assert [r.fields for r in records.split_lines(spark, path).collect()] == [["a", "=", "2"], ["b", "=", "1"]]
    with pytest.raises(Exception, match="already exists"):
        sinks.write_lines(sinks.settings_lines(spark, {}), path)
    sinks.write_lines(sinks.settings_lines(spark, {}), path, overwrite=True)
    assert sinks.write_lines(rows.select("value"), None) is None
    assert [records.emit_settings(n) for n in (5, 20, 100, 1000)] == [(1000, 5), (500, 10), (200, 20), (100, 100)]
    made = records.random_tuples(spark, 50, "S", partitions=2)
    assert made.where("relation = 'S' AND payload.f4 IS NOT NULL AND length(payload.f3) = 15").count() == 50
    assert records.topics_for("1G") == {"orders1G": "R", "tracks1G": "S"}


def test_options(spark):
    o = options.parse(["-op", ">=", "-win", "-wr", "1.5", "--s", "grouped", "-js", "s3"])
    assert (o.join_field_r, o.join_field_s, o.window, options.settings(o)["name"]) == (0, 2, (1.5, 2.0), "tidejoin-grouped")
    for bad in (["-op", "~"], ["-t", "0.5"], ["-pr", "0"], ["-jr", "x"], ["-il", "9", "-iu", "3"], ["-rm", "9"]):
        with pytest.raises(ValueError):
            options.parse(bad)
    with pytest.raises(SystemExit):
        options.parse(["--s", "unknown"])
    r = spark.createDataFrame([(1, 1, at(0)), (1, 1, at(0)), (2, 2, at(0))], "key long, seq long, ts timestamp")
    assert options.plan(options.parse([]), r, r).count() == 2 and options.plan(options.parse(["--no-dedup"]), r, r).count() == 5
    assert options.plan(options.parse(["--no-output"]), r, r).count() == 0
    assert options.plan(options.parse(["--simple-output", "-op", ">"]), r, r).columns == ["key"]
    assert options.plan(options.parse(["-agg"]), r, r).first().n == 2


def test_engine_moves_keys_and_retries(spark):
    rows = [("R" if i % 3 else "S", 7 if i % 10 < 8 else i % 50, i, at(i)) for i in range(120)]
    frame = spark.createDataFrame(rows, "relation string, key long, seq long, ts timestamp")
    engine = Engine(spark, n=3, threshold=1.01)
    for batch in range(3):
        for _ in range(1 + (batch == 1)):  # the second batch is run again
            engine.step(frame.where(F.col("seq") % 3 == batch), batch)
    got = sorted((r.seq_r, r.seq_s) for r in engine.results().collect())
    assert got == sorted((a[2], b[2]) for a in rows for b in rows if a[0] == "R" and b[0] == "S" and a[1] == b[1])
    assert engine.routes().count() > 0


def test_ordered_index_of_other_keys(spark):
    """Text, timestamps, and doubles that lie close together."""
    for keys, low, high in ((["b", "d", "f"], "c", "e"), ([0.1, 0.2, 0.3], 0.25, 0.26)):
        index = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], ["key", "value"])
        ask = spark.createDataFrame([(low,), (high,)], ["key"])
        want = sorted(keys)
        assert {r.key: r.found for r in ordered.floor(index, ask).collect()} == {x: max(k for k in want if k <= x) for x in (low, high)}
        assert {r.key: r.found for r in ordered.ceiling(index, ask).collect()} == {x: min(k for k in want if k >= x) for x in (low, high)}
        assert {r.key: r["rank"] for r in ordered.rank(index, ask).collect()} == {x: sum(k < x for k in want) for x in (low, high)}


def test_generator(spark):
    """Both relations, about half each; a rate that fluctuates by batches; what was emitted, by relation."""
    made = records.random_tuples(spark, 2000).collect()
    assert 850 < sum(r.relation == "R" for r in made) < 1150 and len({r.seq for r in made}) == 2000
    assert all(0 <= r.payload.f1 < 20000 and 0 <= r.payload.f2 < 20000 and len(r.payload.f3) == (20 if r.relation == "R" else 15) for r in made)
    rows = spark.range(1000).withColumnRenamed("id", "seq")
    by_batch = {r.b: r.n for r in records.fluctuating(rows, "seq", 100).groupBy(F.expr("seq div 100").alias("b")).agg(F.count("*").alias("n")).collect()}
    assert len(set(by_batch.values())) > 3 and all(0 < n <= 100 for n in by_batch.values())
    assert records.fluctuating(rows, "seq", 100).count() == sum(by_batch.values())
    made = spark.createDataFrame([("R", 0), ("R", 400_000), ("S", 1_500_000), ("R", 1_600_000)], "relation string, us long").select("relation", F.timestamp_micros("us").alias("ts"))
    assert sorted((r.relation, r.at.second, r.n) for r in records.emitted(made).collect()) == [("R", 0, 2), ("R", 1, 1), ("S", 1, 1)]


def test_a_placed_join_has_one_exchange_a_side(spark):
    rows = spark.range(1000).select(F.col("id").alias("seq"), (F.col("id") % 50).alias("key"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = joins.placed(rows, rows, "grouped", 8, m=2)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 2 == plan.count("shufflepartitionidpassthrough")
