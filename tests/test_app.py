import pytest
from pyspark.sql import functions as F

from tidejoin.plans import app, options


def lines_of(spark, path):
    return sorted(row.value for row in spark.read.text(path).collect())


def test_generated_rates_and_fields(spark):
    o = app.parse(["-tr", "20", "-ts", "30", "-lrt", "4", "-il", "5", "-iu", "9", "-jr", "r1", "-js", "s1"])
    rows = app.generated(spark, o, start_ms=0)
    counts = {r.relation: (r.n, r.first, r.last) for r in rows.groupBy("relation").agg(F.count("*").alias("n"), F.min(F.unix_millis("ts")).alias("first"), F.max(F.unix_millis("ts")).alias("last")).collect()}
    assert counts == {"R": (80, 0, 3950), "S": (120, 0, 3966)}
    r, s = app.relations(o, rows)
    assert {x.key for x in r.collect()} <= {5, 6, 7, 8}
    mixed = app.parse(["-js", "s3"])
    assert [x.schema["key"].dataType.simpleString() for x in app.relations(mixed, rows)] == ["string", "string"]
    both = app.generated(spark, app.parse(["-tr", "0", "-ts", "0", "-trs", "50", "-lrt", "2"]), start_ms=0)
    assert both.count() == 100 and both.select("relation").distinct().count() == 2
    some = app.generated(spark, app.parse(["-tr", "50", "-ts", "50", "-lrt", "4", "-fluc"]), start_ms=0).count()
    assert 0 < some < 400


@pytest.mark.parametrize("strategy", ["hash", "random", "grouped", "routed"])
def test_random_source_to_sink(spark, tmp_path, strategy):
    args = ["--local", "-il", "0", "-iu", "4", "-tr", "8", "-ts", "8", "-lrt", "2", "-win", "-wr", "1", "-ws", "1", "--s", strategy, "-d", str(tmp_path / "log")]
    o = app.parse([*args, "--out", str(tmp_path / "out")])
    rows = app.generated(spark, o, start_ms=0).select("relation", "seq", "ts", F.col("payload.f1").alias("key")).collect()
    r, s = ([x for x in rows if x.relation == side] for side in "RS")
    near = lambda a, b: abs((b.ts - a.ts).total_seconds()) <= 1
    expected = sorted(f"R: {a.seq} ---- {b.seq}" if a.ts > b.ts else f"S: {b.seq} ---- {a.seq}" for a in r for b in s if a.key == b.key and near(a, b))
    assert lines_of(spark, app.run(spark, o)) == expected
    assert app.run(spark, app.parse(["--local", "-lrt", "1", "--no-output", "--out", str(tmp_path / "none")])) is None


@pytest.mark.parametrize("strategy", ["hash", "random", "grouped", "routed"])
def test_records_of_files(spark, tmp_path, strategy):
    place = {"a": "30.703971", "b": "-10.5"}
    for name, rows in (("r", "ab"), ("s", "aab")):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "part.txt").write_text("".join(f"{name}{i},x,,104.09464,{place[p]}\n" for i, p in enumerate(rows)) + "short,line\n")
    o = app.parse(["--source", "files", "--r-path", str(tmp_path / "r"), "--s-path", str(tmp_path / "s"), "--s", strategy, "--simple-output", "--out", str(tmp_path / "out")])
    pairs = [tuple(part.split(",")[0] for part in line.split(" | ")) for line in lines_of(spark, app.run(spark, o))]
    assert pairs == [("r0", "s0"), ("r0", "s1"), ("r1", "s2")]


def test_option_bounds():
    options.parse(["-trs", "0", "-tr", "0", "-ts", "0", "--no-dedup", "--dedup-size", "0"])
    for bad in (["-win", "-wr", "0"], ["--dedup-size", "0"], ["-tr", "-1"], ["-ai", "0"], ["-c", "0"]):
        with pytest.raises(ValueError):
            options.parse(bad)
    with pytest.raises(SystemExit):
        app.parse(["--source", "files"])
    with pytest.warns(UserWarning, match="-ks, --dedup-size"):
        options.parse(["-ks", "3", "--dedup-size", "7"])
