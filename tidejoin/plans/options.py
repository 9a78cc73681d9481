"""Options of a join application, from a command line, and the plan that they ask for."""

from __future__ import annotations

import argparse
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidejoin.functions import scalars
from tidejoin.operators import joins, metrics


#: Options that are checked and shown in the settings only; README says why.
WITHOUT_EFFECT = ("-ks", "-f1", "-f2", "-g", "-n", "-ps", "-sm", "--index-size", "--dedup-size", "-x")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidejoin", description="Joins two streams or tables, R and S.", allow_abbrev=False)
    add = p.add_argument
    add("-R", default="r1, r2, r3", metavar="FIELDS", help="fields of R, by commas")
    add("-S", default="s1, s2, s3, s4", metavar="FIELDS", help="fields of S, by commas")
    add("-jr", default=None, metavar="FIELD", help="join field of R (its first)")
    add("-js", default=None, metavar="FIELD", help="join field of S (its first)")
    add("-op", default="=", help="comparison: = != > >= < <=")
    add("--name", default="tidejoin", help="application name; the strategy is added to it")
    add("--local", action="store_true", help="run in one process")
    add("-lrt", type=int, default=5, help="seconds that a local run lasts")
    add("--debug", action="store_true")
    add("-n", type=int, default=2, help="workers")
    add("-ks", type=int, default=2, help="source partitions")
    add("-f1", type=int, default=4, help="parsing partitions")
    add("-f2", type=int, default=4, help="routing partitions")
    add("-pr", type=int, default=8, help="instances that store R")
    add("-ps", type=int, default=8, help="instances that store S")
    add("-g", type=int, default=1, help="gathering partitions")
    add("-trs", type=int, default=20, help="generated tuples a second, both relations")
    add("-tr", type=int, default=10, help="generated tuples a second, R")
    add("-ts", type=int, default=10, help="generated tuples a second, S")
    add("-fluc", action="store_true", help="let the generated rate vary")
    add("--index-size", type=int, default=2048, dest="index_size", help="rows in a stored part")
    add("-win", action="store_true", help="join within a window")
    add("-wr", type=float, default=2.0, help="window of R in seconds")
    add("-ws", type=float, default=2.0, help="window of S in seconds")
    add("--no-dedup", action="store_true", dest="no_dedup", help="keep repeated results")
    add("--dedup-size", type=int, default=500_000, dest="dedup_size", help="results looked back at for repeats")
    add("-agg", action="store_true", help="aggregate results by time")
    add("-ai", type=int, default=1, help="seconds of an aggregate")
    add("--no-output", action="store_true", dest="no_output", help="write no results")
    add("--simple-output", action="store_true", dest="simple_output", help="write keys only")
    add("-d", default=None, metavar="DIR", help="folder for the settings")
    add("-x", default="", metavar="TEXT", help="a note for the log")
    add("-z", default="tidejoin", metavar="GROUP", help="consumer group")
    add("-il", type=int, default=0, help="least generated integer")
    add("-iu", type=int, default=20_000, help="bound of generated integers")
    add("-dl", type=float, default=0.0, help="least generated double")
    add("-du", type=float, default=20_000.0, help="bound of generated doubles")
    add("-c", type=int, default=20, help="length of generated text")
    add("--s", default="hash", dest="strategy", choices=joins.STRATEGIES, help="placement")
    add("--size", default="10G", help="data size, the end of the topics' names")
    add("-st", type=int, default=5000, help="milliseconds before keys are moved")
    add("-t", type=float, default=2.5, help="imbalance above which keys are moved")
    add("-i", type=int, default=1000, help="milliseconds between checks of the balance")
    add("-rm", type=int, default=2, help="members of a group that stores R")
    add("-sm", type=int, default=2, help="members of a group that stores S")
    return p


def parse(args: list[str], by: argparse.ArgumentParser | None = None) -> argparse.Namespace:
    o = (by or parser()).parse_args(args)
    o.jr, o.js = o.jr or scalars.parse_schema(o.R)[0], o.js or scalars.parse_schema(o.S)[0]
    o.join_field_r, o.join_field_s = scalars.field_index(o.R, o.jr), scalars.field_index(o.S, o.js)
    o.window = (o.wr, o.ws) if o.win else None
    if o.op not in joins.OPERATORS:
        raise ValueError(f"-op {o.op}: no such comparison")
    for name in ("n", "ks", "f1", "f2", "pr", "ps", "g", "index_size", "ai", "lrt", "i", "rm", "sm", "c"):
        if getattr(o, name) <= 0:
            raise ValueError(f"-{name} must be above 0")
    for name in ("trs", "tr", "ts", "st"):
        if getattr(o, name) < 0:
            raise ValueError(f"-{name} must not be below 0")
    if o.win and min(o.wr, o.ws) <= 0:
        raise ValueError("-wr and -ws must be above 0")
    if not o.no_dedup and o.dedup_size <= 0:
        raise ValueError("--dedup-size must be above 0")
    if o.t < 1:
        raise ValueError("-t must be 1 or more")
    if o.il >= o.iu or o.dl >= o.du:
        raise ValueError("a range of generated values is empty")
    if o.rm > o.pr or o.sm > o.ps:
        raise ValueError("a group has more members than there are instances")
    if given := [name for name in WITHOUT_EFFECT if name in args]:
        warnings.warn(f"without an effect here: {', '.join(given)}", stacklevel=2)
    return o


def settings(o: argparse.Namespace) -> dict:
    return {**vars(o), "name": f"{o.name}-{o.strategy}"}


def placement_options(o: argparse.Namespace) -> dict:
    return {} if o.strategy == "hash" else {"n": o.pr, "m": o.rm}


def plan(o: argparse.Namespace, r: DataFrame, s: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """The join that the options ask for, of relations with key, ts and seq."""
    if o.strategy == "routed" and routes is None:
        routes = r.sparkSession.createDataFrame([], "relation string, key string, target int").withColumn("key", F.col("key").cast(r.schema["key"].dataType))
    extra = placement_options(o) | ({"routes": routes} if o.strategy == "routed" else {})
    out = joins.join(r, s, o.op, o.window, o.strategy, dedup=not o.no_dedup, **extra)
    if o.agg:
        return metrics.result_aggregate(out.withColumn("ts", F.greatest("ts_r", "ts_s")), "seq_r", o.ai)
    if o.simple_output:
        return out.select("key" if "key" in out.columns else F.col("key_r").alias("key"))
    return out.limit(0) if o.no_output else out
