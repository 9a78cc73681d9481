"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

Each source's documents, shuffled by a keyed hash, lie end to end on a line of words, cut into blocks of equal length
(a line's last one is shorter).
The schedule's slot i falls at the fractional part of i times the golden ratio; the sources' cumulative shares of the slots that their targets need map it to a source.
The slots of a source are ranked, and the slot of rank r takes the source's block r modulo its number of blocks. A source's
last slot is cut at its target; slots beyond it are passed over. Blocks are taken in order, so a document is taken in whole,
twice, or not at all, but for one cut at the target in each source.
A document's first_slot and last_slot are the first and the last slot that takes words of it: read by slot, the mix has every source near its share from the start on.

Targets: sources in code point order (null last) weigh `weights`, repeating. They share `share` times all words. A target stops
at `most` times its source's words, and the excess goes to the others by weight, until none is above. That is
least(most * words, level * weight) for one level, which a window over the sources, sorted by the level at which each is full, finds.

Prefix sums over a source's documents and slots are made in two steps, within hash prefixes (as many as the rows call for; or runs of slots) and over
their totals, so that no task ever holds a source. The only rows that meet in one task are one per source.

Defined results: a null or wordless text has size 0 and is taken 0 times, with null slots; a document without doc_id is shuffled by its text; repeated rows are
documents of their own; a very long text is cut over many blocks like any other; a source without words has target 0; an empty table gives an empty result. Other columns aren't read, and pass through `mixed_documents` whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table, whole_rows, with_bounded

WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 1024
SEED = "mix-1"
GOLDEN = (5**0.5 - 1) / 2
#: Times the slots that the targets need. Neighbouring points of n golden-ratio points are less than 2 / n apart, so twice as many give each source its own.
SPARE = 2
#: Cells of [0, 1) on which points and shares are joined; slots ranked together.
CELLS, RUN = 1024, 4096


#: Rows of a source and a hash prefix that are ranked together, about.
PREFIX_ROWS = 50_000


def sized(docs: DataFrame, seed: str = SEED, row: str | None = None) -> DataFrame:
    """doc_id, source, size in words, the shuffling hash, and a row number that tells repeated rows apart: that of the column `row` names, if it is given."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.md5(text)), F.lit(f":{seed}")))
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    return docs.select("doc_id", "source", size.alias("size"), order.alias("order"), number.alias("row"))


def source_targets(words: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """source, n (its place), source_size, target."""
    sources = words.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumn("n", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    all_rows = Window.partitionBy()
    fuller = Window.orderBy(F.col("cap") / F.col("weight"), "n").rowsBetween(Window.unboundedPreceding, -1)
    total = share * F.sum("source_size").over(all_rows)
    before = lambda c: F.coalesce(F.sum(c).over(fuller), F.lit(0))
    sources = sources.withColumn("level", (total - before("cap")) / (F.sum("weight").over(all_rows) - before("weight")))
    sources = sources.withColumn("level", F.max("level").over(all_rows))
    sources = sources.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    return sources.select("source", "n", "source_size", "target")


def shares(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """targets with the slots that each source needs, and [lo, hi), its part of [0, 1) by these."""
    words = F.round("target").cast("long")
    blocks = F.expr(f"(source_size + {block_words - 1}) div {block_words}")
    rest = F.ceil((words - F.col("passes") * F.col("source_size")) / block_words)
    out = targets.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0))
    out = out.withColumn("blocks", blocks).withColumn("slots", F.col("passes") * F.col("blocks") + rest).drop("passes")
    all_slots = F.sum("slots").over(Window.partitionBy())
    out = out.withColumn("hi", F.coalesce(F.try_divide(F.sum("slots").over(Window.orderBy("n")), all_slots), F.lit(0.0)))
    return out.withColumn("lo", F.coalesce(F.try_divide(F.col("hi") * all_slots - F.col("slots"), all_slots), F.lit(0.0)))


def schedule(spark: SparkSession, sources: DataFrame, n_sources: int, slots: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, n, block, pass and `words`, those taken of the block, for every slot that the schedule gives to a source before its target is met."""
    step = GOLDEN * 2**20 % 1
    point = ((F.col("id") / 2**20).cast("long") * step + (F.col("id") % 2**20) * GOLDEN) % 1
    points = spark.range(SPARE * slots + 1).withColumn("point", point).withColumn("cell", F.floor(F.col("point") * CELLS))
    last = F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1))
    parts = sources.where("slots > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), last)))
    drawn = with_bounded(points, parts, ["cell"], n_sources + CELLS, how="inner").where("point >= lo AND (point < hi OR hi >= 1)")
    drawn = drawn.withColumn("run", (F.col("id") / RUN).cast("long"))
    # Ranks: within runs of slots, and over the runs' totals.
    runs = drawn.groupBy("n", "run").agg(F.count("*").alias("here"))
    ahead = Window.partitionBy("n").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("n", "run", F.coalesce(F.sum("here").over(ahead), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("n", "run").orderBy("id")) - 1
    ranked = drawn.withColumn("within", within).join(runs, ["n", "run"]).withColumn("rank", F.col("ahead") + F.col("within"))
    ranked = ranked.withColumn("block", F.col("rank") % F.col("blocks")).withColumn("pass", F.expr("rank div blocks"))
    left = F.round("target").cast("long") - F.col("pass") * F.col("source_size") - F.col("block") * block_words
    length = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words)
    return ranked.withColumn("words", F.least(left, length)).where("words > 0").select(F.col("id").alias("slot"), "n", "block", "pass", "words")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, row: str | None = None) -> DataFrame:
    """A row per document (numbered by the column that `row` names, if it is given): doc_id, source, row, size, source_size, target (its source's), taken (its words that the mix takes, repeats counted), first_slot, last_slot (null if none)."""
    spark = docs.sparkSession
    words = checkpointed(sized(docs, seed, row))
    sources = checkpointed(shares(source_targets(words, weights, share, most), block_words))
    n_sources, slots = sources.agg(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0))).first()
    digits = max(3, math.ceil(math.log(max(1, words.count() / PREFIX_ROWS), 16)))

    known = words.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")))
    keyed = sources.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")).alias("source_key"), "n", "source_size", "target")
    known = with_bounded(known, keyed, ["source_key"], n_sources).drop("source_key")

    # Each document's place on its source's line, in hash order. Those without words need none.
    hashed = known.where("size > 0").withColumn("prefix", F.substring("order", 1, digits))
    totals = hashed.groupBy("n", "prefix").agg(F.sum("size").alias("here"))
    ahead = Window.partitionBy("n").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("n", "prefix", F.coalesce(F.sum("here").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("n", "prefix").orderBy("order", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = hashed.withColumn("end", F.sum("size").over(within)).join(totals, ["n", "prefix"])
    placed = placed.select("row", "size", "n", (F.col("ahead") + F.col("end") - F.col("size")).alias("start"))

    # The blocks that each document touches, joined with the slots that take them, and how far these do.
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    cut = placed.withColumn("block", F.explode(F.sequence(first, last))).withColumn("begin", F.col("block") * block_words)
    cut = cut.select("row", "n", "block", "begin", F.greatest("start", "begin").alias("a"), F.least(F.col("start") + F.col("size"), F.col("begin") + block_words).alias("b"))
    taken = schedule(spark, sources, n_sources, slots, block_words).groupBy("n", "block").agg(F.collect_list(F.struct("slot", "words")).alias("visits"))
    seen = F.filter("visits", lambda v: F.col("begin") + v["words"] > F.col("a"))
    got = F.aggregate("seen", F.lit(0).cast("long"), lambda s, v: s + F.least(F.col("b"), F.col("begin") + v["words"]) - F.col("a"))
    visited = cut.join(taken, ["n", "block"]).withColumn("seen", seen).where(F.size("seen") > 0)
    visited = visited.select("row", got.alias("taken"), F.array_min("seen.slot").alias("first_slot"), F.array_max("seen.slot").alias("last_slot"))
    per_row = visited.groupBy("row").agg(F.sum("taken").alias("taken"), F.min("first_slot").alias("first_slot"), F.max("last_slot").alias("last_slot"))
    return known.join(per_row, "row", "left").select("doc_id", "source", "row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "last_slot")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: a row for each time that a document is taken, to the nearest whole number, in the schedule's order (a first time by its first slot, a second by its last); columns stay."""
    held = checkpointed(docs.select(whole_rows(docs), F.monotonically_increasing_id().alias("row")), 5_000)
    mixed = checkpointed(mix(held.select("doc.doc_id", "doc.source", "doc.text", "row"), row="row").where("taken > 0"), 1_000_000)
    slots = F.slice(F.array("first_slot", "last_slot"), 1, F.round(F.col("taken") / F.col("size")).cast("int"))
    times = mixed.select("row", F.explode(slots).alias("slot"))
    # Slots are even numbers of what is to be written, so parts of equal length of them are parts of the order.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = mixed.agg(F.coalesce(F.max("last_slot"), F.lit(0))).first()[0] + 1
    dealt = held.join(times, "row").withColumn("part", F.floor(F.col("slot") * parts / end).cast("int"))
    return dealt.repartitionById(parts, "part").sortWithinPartitions("slot", "row").select("doc.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


#: The same mix, slot by slot.
ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':{SEED}') AS h, row_number() OVER () AS row
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n
  FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][((n - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM sources),
levels AS (
  SELECT *, (1.5 * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER f, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS level
  FROM weighed
  WINDOW f AS (ORDER BY cap::DOUBLE / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, n, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
counted AS (SELECT *, round(target)::BIGINT AS words, (source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS blocks, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS passes FROM targets),
needed AS (SELECT *, (passes * blocks + ceil((words - passes * source_size) / {BLOCK_WORDS}::DOUBLE))::BIGINT AS slots FROM counted),
summed AS (SELECT *, sum(slots) OVER ()::DOUBLE AS all_slots, (sum(slots) OVER (ORDER BY n))::DOUBLE / (sum(slots) OVER ())::DOUBLE AS hi FROM needed),
parts AS (SELECT *, (hi * all_slots - slots) / all_slots AS lo FROM summed WHERE slots > 0),
points AS (SELECT id, ((id // 1048576)::DOUBLE * '{GOLDEN * 2**20 % 1!r}'::DOUBLE + (id % 1048576)::DOUBLE * '{GOLDEN!r}'::DOUBLE) % 1.0::DOUBLE AS point
           FROM (SELECT unnest(range({SPARE} * (SELECT sum(slots) FROM needed)::BIGINT + 1)) AS id)),
ranked AS (SELECT p.*, id, row_number() OVER (PARTITION BY n ORDER BY id) - 1 AS rank FROM points JOIN parts p ON point >= lo AND (point < hi OR hi >= 1)),
slots AS (
  SELECT n, id AS slot, rank % blocks AS block, least(words - rank // blocks * source_size - rank % blocks * {BLOCK_WORDS}, {BLOCK_WORDS}, source_size - rank % blocks * {BLOCK_WORDS}) AS words FROM ranked),
placed AS (
  SELECT s.doc_id, s.row, s.size, t.n, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
visits AS (
  SELECT p.row, s.slot, least(p.start + p.size, s.block * {BLOCK_WORDS} + s.words) - greatest(p.start, s.block * {BLOCK_WORDS}) AS got
  FROM placed p JOIN slots s ON p.n = s.n AND p.size > 0 AND s.words > 0 AND s.block BETWEEN p.start // {BLOCK_WORDS} AND (p.start + p.size - 1) // {BLOCK_WORDS}),
taken AS (SELECT row, sum(got)::BIGINT AS taken, min(slot) AS first_slot, max(slot) AS last_slot FROM visits WHERE got > 0 GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, last_slot FROM placed LEFT JOIN taken USING (row)
"""
