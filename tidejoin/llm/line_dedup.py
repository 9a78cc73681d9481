"""Line deduplication over a suffix array of line-ID sequences, made by distributed prefix doubling.

Each document is a sequence of line IDs (128-bit hashes of its lines without white space at their end) that ends in a mark of its own. At level j
every suffix is ranked by its first 2^j lines: distinct pairs of (rank of the first half, rank of the second half) are
sorted across the cluster, and a pair's place in that order is its rank. Suffixes whose first 2^j lines occur nowhere else are settled and
leave the table, as they share no longer prefix with any other; levels are added until none is left.

A longest-common-prefix interval of the suffix array is the set of suffixes that share their first n lines. It is named by n and its first
suffix in (doc_id, line) order, which is kept. As n falls, intervals merge: where one loses to another whose first suffix is earlier, its own first suffix has found the
longest run of lines that it shares with an earlier place. So only the first suffixes of intervals are looked at, and n is found
for all at once, bit by bit, by splitting each span of lengths at its middle with the ranks of that level. A place's run is a maximal repeated run
if it can't be extended: not to the right by its length, and not to the left if the place before has no run that holds it. These runs, with `min_words` words or more, are listed with their first copy and
deleted, so a later copy of any repeated run goes whole.

Defined results: lines are parted by newlines; empty lines have no words and go only inside a deleted run. A null text has no lines and
stays null. Rows with the same doc_id and text are one document to the operator, so each keeps what the others keep. A null doc_id
comes after all others. A text all of whose lines go becomes empty. A later copy may overlap the place that it copies (a line said thrice). A very long text is a row for each line, until it is cut. Extra columns pass through untouched; `line_dedup`
puts its report in place of columns named n_lines, removed or runs, `cut_lines` and the pipeline keep these too.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from .common import checkpointed, map_slices, salted_join, shared_folder, table, utf8, whole_rows

#: Fewest words of a repeated run: with 1 every maximal repeated run counts that has a line that isn't empty.
MIN_WORDS = 1
BLANK = b" \t\n\x0b\x0c\r"
#: A document: its doc_id (null as the largest long) and a hash of its text.
KEY = ["d", "h"]
LINES = "d long, h long, at int, id binary, ahead int"
#: An interval: the lines that its suffixes share, and its first suffix.
INTERVAL = ["n", "fd", "fh", "fat"]
RUNS = "array<struct<at: int, n_lines: int, first_doc_id: bigint, first_at: int, copies: bigint>>"
#: Rows of suffixes that a task makes and writes.
TASK_ROWS = 100_000


class Kept(NamedTuple):
    """A table in the folder that all executors share, and how many rows it has."""

    rows: DataFrame
    n: int


def _together(df: DataFrame, most: int) -> DataFrame:
    """df, of `most` rows at most, in one partition if a task takes them all: what is made of such tables needs no shuffle, and the driver, whose memory grows with the jobs and broadcasts of a run, has few to start."""
    return df.coalesce(1) if most <= TASK_ROWS else df


def _beside(df: DataFrame, most: int) -> DataFrame:
    """df for a join of tables that have `most` rows at most. If these lie together, they are merged where they are, without a broadcast."""
    return df.hint("merge") if most <= TASK_ROWS else df


def _kept(df: DataFrame, most: int) -> Kept:
    """df, computed once and read again from the shared folder, as `checkpointed` does. It has `most` rows at most, so small partitions of a shuffle, which a cache keeps as they are, are made in as few tasks as that takes."""
    shared_folder(df.sparkSession)
    held = df.coalesce(max(1, -(-most // TASK_ROWS))).persist(StorageLevel.MEMORY_AND_DISK)
    n = held.count()
    out = held.checkpoint(eager=True)
    held.unpersist()
    return Kept(_together(out, n), n)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("d", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))).withColumn("h", F.xxhash64(text))


def _shortest(words: np.ndarray, least: int, stop: np.ndarray) -> np.ndarray:
    """For each line, how many lines from it on have `least` words; 0 where its text, whose lines lie before `stop`, ends before."""
    ends = np.cumsum(words)
    last = np.searchsorted(ends, ends - words + least)
    return np.where(last < stop, last - np.arange(len(words)) + 1, 0)


def sequences(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """A row per line, as LINES says: its document, place and ID, and the length of the shortest run of min_words words from it on."""

    def lines(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [x.split(b"\n") for x in utf8(batch.column(2))]
        n = np.array([len(x) for x in parts], np.int64)
        bare = [line.rstrip(BLANK) for x in parts for line in x]
        ids = [hashlib.blake2b(line, digest_size=16).digest() for line in bare]
        words = np.fromiter((len(x.split()) if min_words > 1 else len(x) > 0 for x in bare), np.int64, len(bare))
        own, stop = np.repeat(np.arange(len(parts)), n), np.cumsum(n)
        at, ahead = np.arange(len(bare)) - (stop - n)[own], _shortest(words, min_words, stop[own])
        columns = [batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array(at.astype(np.int32)), pa.array(ids, pa.binary()), pa.array(ahead.astype(np.int32))]
        return pa.record_batch(columns, [x.split()[0] for x in LINES.split(", ")])

    rows = _keyed(docs.select("doc_id", F.col(text).cast("string").alias("text")).where("text IS NOT NULL"), "text").select("d", "h", "text")
    return map_slices(rows, lines, LINES)


def _ranked(suffixes: DataFrame, by: list[str], most: int) -> Kept:
    """The suffixes, `most` at most, whose `by` occurs more than once, with the place of `by` in its sorted order as rank, its first suffix and its copies. Salted by document, as a line (the empty one, say) may be in all of them."""
    pairs = suffixes.groupBy(*by).agg(F.count("*").alias("copies"), F.min(F.struct(*KEY, "at")).alias("f")).where("copies > 1")
    pairs = pairs.select(*by, "copies", F.col("f.d").alias("fd"), F.col("f.h").alias("fh"), F.col("f.at").alias("fat"))
    ranged = pairs.coalesce(1) if most <= TASK_ROWS else pairs.repartitionByRange(*by)
    order = _kept(ranged.sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), most // 2)
    return _kept(salted_join(suffixes, _beside(order.rows, most), by, "h", salts=4).drop(*by), most)


def suffix_levels(lines: DataFrame) -> list[Kept]:
    """Level by level, (d, h, at, rank, copies, fd, fh, fat) of the suffixes whose first 2^level lines occur elsewhere too, until there are none; the first level with `ahead` too."""
    places = lines.select(*KEY, "at", "id", "ahead")
    start = lambda c: F.when(F.col("at") == 0, F.col(c))
    n, starts, documents = places.agg(F.count("*"), F.count(start("d")), F.countDistinct(*map(start, KEY))).first()
    if starts > documents:
        places = places.dropDuplicates([*KEY, "at"])
    levels, level = [], _ranked(_together(places, n), ["id"], n)
    while level.n:
        levels.append(level)
        step = 2 ** (len(levels) - 1)
        then = level.rows.select(*KEY, (F.col("at") - step).alias("at"), F.col("rank").alias("rank2"))
        level = _ranked(level.rows.select(*KEY, "at", F.col("rank").alias("rank1")).join(_beside(then, level.n), [*KEY, "at"]), ["rank1", "rank2"], level.n)
    return levels


def _is_first() -> Column:
    return F.struct(*KEY, "at") == F.struct("fd", "fh", "fat")


def _merging(members: DataFrame, most: int) -> DataFrame:
    """The members, `most` at most, of intervals with others than their first."""
    members = _together(members, most)
    names = members.where(~_is_first()).select(*INTERVAL).distinct()
    return salted_join(members, _beside(names, most), INTERVAL, "h", salts=4, how="left_semi")


def _entering(level: Kept, longer: DataFrame | None, n: int) -> DataFrame:
    """The intervals of n lines: of each, the first suffixes of its intervals of 2n lines, and the suffixes that share 2n lines with no other."""
    own = level.rows.select(*KEY, "at", F.lit(n).alias("n"), "fd", "fh", "fat", "copies", F.lit(1).cast("long").alias("members"))
    if longer is None:
        return own
    up = longer.select(*KEY, "at", F.struct("fd", "fh", "fat").alias("up"), F.col("copies").alias("of_up"))
    first = F.col("up").isNull() | (F.struct(*KEY, "at") == F.col("up"))
    out = own.join(_beside(up, level.n), [*KEY, "at"], "left").where(first)
    return out.select(*KEY, "at", *INTERVAL, "copies", F.coalesce("of_up", "members").alias("members"))


def _split(members: Kept, level: Kept, half: int) -> DataFrame:
    """Members of intervals of n lines, each the first of those that share n + 2 half lines, by n + half: those that meet there with their new interval, and the first of each with the old one."""
    then = _beside(level.rows.select(*KEY, F.col("at").alias("tail"), "rank"), max(members.n, level.n))
    ranked = _kept(members.rows.withColumn("tail", F.col("at") + F.col("n")).join(then, [*KEY, "tail"], "left").drop("tail"), members.n).rows
    alone = ranked.where("rank IS NULL").drop("rank")
    met = ranked.where("rank IS NOT NULL").groupBy(*INTERVAL, "rank").agg(F.min(F.struct(*KEY, "at")).alias("first"), F.sum("members").alias("together"), F.first("copies").alias("copies"), F.count("*").alias("rows"))
    met = _kept(met, members.n).rows
    longer = salted_join(ranked.drop("copies"), _beside(met.where("rows > 1").drop("copies", "rows"), members.n), [*INTERVAL, "rank"], "h", salts=4)
    longer = longer.select(*KEY, "at", (F.col("n") + half).alias("n"), F.col("first.d").alias("fd"), F.col("first.h").alias("fh"), F.col("first.at").alias("fat"), F.col("together").alias("copies"), "members")
    firsts = met.select("first.d", "first.h", "first.at", *INTERVAL, "copies", F.col("together").alias("members"))
    return longer.unionByName(_merging(alone.unionByName(firsts), members.n))


def longest_earlier(levels: list[Kept]) -> DataFrame:
    """d, h, at, n, fd, fh, fat, copies: for each place, the most lines from it on that an earlier place has too, their first place and how many places have them."""
    members = None
    for j in reversed(range(len(levels))):
        level = levels[j]
        entering = _merging(_entering(level, levels[j + 1].rows if j + 1 < len(levels) else None, 2**j), level.n)
        if members is None:
            members = _kept(entering, level.n)
        else:  # a member stays, and may be the first of those that it meets
            members = _kept(_split(members, level, 2**j).unionByName(entering), 2 * members.n + level.n)
    return members.rows.where(~_is_first()).drop("members")


def later_copies(lines: DataFrame) -> DataFrame:
    """d, h, at, n, fd, fh, fat, copies: the maximal repeated runs of enough words that an earlier place has too, with their first place."""
    levels = suffix_levels(lines)
    if not levels:
        return lines.sparkSession.createDataFrame([], "d long, h long, at int, n int, fd long, fh long, fat int, copies long")
    runs = longest_earlier(levels)
    before = runs.select(*KEY, (F.col("at") + 1).alias("at"), (F.col("n") - 1).alias("left"))
    maximal = runs.join(before, [*KEY, "at"], "left").where("left IS NULL OR left < n").drop("left")
    return maximal.join(levels[0].rows.select(*KEY, "at", "ahead"), [*KEY, "at"]).where("ahead BETWEEN 1 AND n").drop("ahead")


def cut_lines(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc (a struct of the document's other columns as they were), text (without the lines of later copies), n_lines, removed (places of the deleted lines), runs (the maximal repeated runs that went, with their first copy)."""
    copies = later_copies(checkpointed(sequences(docs, text, min_words), 100_000))
    per_doc = copies.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("at", F.col("n").alias("n_lines"), F.when(F.col("fd") < 2**63 - 1, F.col("fd")).alias("first_doc_id"), F.col("fat").alias("first_at"), "copies"))).alias("runs"))
    others = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != text))
    whole = docs.select(whole_rows(others), F.col("doc_id"), F.col(text).cast("string").alias("text"))
    rows = _keyed(whole, "text").join(per_doc, KEY, "left").select("doc", "text", F.coalesce("runs", F.array()).cast(RUNS).alias("runs"))
    schema = T.StructType([rows.schema["doc"]]).add("text", T.StringType()).add("n_lines", T.IntegerType()).add("removed", T.ArrayType(T.IntegerType())).add(rows.schema["runs"])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts, removed = [], [], []
        runs, edges = batch.column(2).flatten(), batch.column(2).value_lengths().to_numpy(zero_copy_only=False).cumsum().tolist()
        at, n = runs.field("at").to_pylist(), runs.field("n_lines").to_pylist()
        for whole, first, last in zip(batch.column(1).to_pylist(), [0, *edges], edges):
            gone = set().union(*(range(at[k], at[k] + n[k]) for k in range(first, last)))
            lines = whole.split("\n") if gone else []
            texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else whole)
            counts.append(whole.count("\n") + 1 if whole is not None else 0)
            removed.append(sorted(gone))
        return pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(removed, pa.list_(pa.int32())), batch.column(2)], ["doc", "text", "n_lines", "removed", "runs"])

    return map_slices(rows, cut, schema)


def own_columns(docs: DataFrame, **instead: Column) -> list[Column]:
    """The columns of docs out of the struct `doc`, but for those given."""
    return [instead.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns]


def line_dedup(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with the lines of later copies deleted from their text, and n_lines, removed (places of the deleted lines), runs (at, n_lines, first_doc_id, first_at, copies of each run that went) after their own columns."""
    out = cut_lines(docs, text, min_words)
    return out.select(*own_columns(docs.drop("n_lines", "removed", "runs"), **{text: F.col("text")}), "n_lines", "removed", "runs")


def without_line_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies of lines; those of which nothing but white space is left go. Columns stay; n_chars counts anew."""
    out = cut_lines(docs, "text", min_words).where(F.col("text").isNull() | (F.size("removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return out.select(*own_columns(docs, **changed))


#: A query's columns for the fields of its runs.
LISTED = {"at": "run_at", "n_lines": "run_lines", "first_doc_id": "run_first_doc", "first_at": "run_first_at", "copies": "run_copies"}


def _report(spark: SparkSession, sf_dir: str, min_words: int) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=min_words)
    return out.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", "text", *(F.col(f"runs.{c}").alias(name) for c, name in LISTED.items()))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (places of the deleted lines), text that stays, and of each run that went run_at, run_lines, run_first_doc, run_first_at, run_copies."""
    return _report(spark, sf_dir, MIN_WORDS)


def op8_line_dedup_50_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op8_line_dedup, but only repeated runs with 50 words or more count."""
    return _report(spark, sf_dir, 50)


#: Places with the same line, along each diagonal of two documents, give the lines that two places share; a place's longest run with an earlier place counts if the place before has none that holds it.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents),
counted AS (
  SELECT *, rtrim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS words FROM lines),
summed AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS ends FROM counted),
met AS (
  SELECT s.doc_id, s.pos, t.doc_id AS t_doc, t.pos AS t_pos,
         s.pos - row_number() OVER (PARTITION BY s.doc_id, t.doc_id, s.pos - t.pos ORDER BY s.pos) AS island
  FROM counted s JOIN counted t ON s.line = t.line AND (s.doc_id, s.pos) <> (t.doc_id, t.pos)),
shared AS (SELECT *, max(pos) OVER (PARTITION BY doc_id, t_doc, pos - t_pos, island) - pos + 1 AS n FROM met),
longest AS (SELECT doc_id, pos, max(n) AS n FROM shared WHERE (t_doc, t_pos) < (doc_id, pos) GROUP BY ALL),
maximal AS (
  SELECT l.* FROM longest l LEFT JOIN longest b ON b.doc_id = l.doc_id AND b.pos = l.pos - 1
  WHERE b.n IS NULL OR b.n <= l.n),
runs AS (
  SELECT m.doc_id, m.pos, m.n, min({'d': s.t_doc, 'p': s.t_pos}) AS first, count(*) + 1 AS copies
  FROM maximal m JOIN shared s ON s.doc_id = m.doc_id AND s.pos = m.pos AND s.n >= m.n
  JOIN summed a ON a.doc_id = m.doc_id AND a.pos = m.pos JOIN summed z ON z.doc_id = m.doc_id AND z.pos = m.pos + m.n - 1
  WHERE z.ends - a.ends + a.words >= 1
  GROUP BY ALL),
listed AS (
  SELECT doc_id, list(pos::INT ORDER BY pos) AS run_at, list(n::INT ORDER BY pos) AS run_lines, list(first.d ORDER BY pos) AS run_first_doc,
         list(first.p::INT ORDER BY pos) AS run_first_at, list(copies ORDER BY pos) AS run_copies
  FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT s.doc_id, s.pos FROM counted s JOIN runs r ON s.doc_id = r.doc_id AND s.pos BETWEEN r.pos AND r.pos + r.n - 1)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::INT AS n_lines, coalesce(len(g.removed), 0)::INT AS n_removed, coalesce(g.removed, []) AS removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text,
       coalesce(run_at, []) AS run_at, coalesce(run_lines, []) AS run_lines, coalesce(run_first_doc, []) AS run_first_doc,
       coalesce(run_first_at, []) AS run_first_at, coalesce(run_copies, []) AS run_copies
FROM documents d
LEFT JOIN (SELECT doc_id, list(pos::INT ORDER BY pos) AS removed FROM gone GROUP BY doc_id) g USING (doc_id)
LEFT JOIN (SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.pos) AS kept
           FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id) k USING (doc_id)
LEFT JOIN listed USING (doc_id)
"""

#: The same with at least 50 words.
ORACLE_50_WORDS = ORACLE.replace("a.words >= 1", "a.words >= 50")
