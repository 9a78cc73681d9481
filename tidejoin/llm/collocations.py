r"""Collocations: phrases of two to four words that hold together more than their parts suggest, by language.

Texts are cut into pieces, and identical pieces are one with a multiplicity, so boilerplate is looked at once. Pieces are read twice. The first time gives words and word pairs; the second gives the phrases
of three and four words, but only those whose every word pair is frequent, as no frequent phrase has a rare one. Which pairs are frequent is told by a filter of hash bits: a pair that it lets through by chance costs
a row and changes nothing. A task sums up what it has, and the sums are dealt to buckets by a hash of the phrase; each bucket is counted by an in-process duckdb, which spills to disk what its memory doesn't hold.

A candidate's parts lie in other buckets than the candidate. It sends a request for each part of each cut to the part's bucket, where the count is joined, and the answers go back to the candidate. In the same
way each candidate tells the shorter phrases inside it how often it occurs itself, which decides on those that only ever stand inside a longer one.

Defined results: A-Z count as lower case; pieces are parted by [.,;:!?] and line ends, words by blanks and tabs; a null language is 'und', a null text is empty; counts and scores are exact beyond 64 bits; repeated rows are documents each;
ties of score go by count, then by the phrase's bytes; a very long text or piece is read whole; a language without candidates has no rows, and an empty table gives an empty result. Other columns, doc_id among them, aren't read.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, salted_join, shared_folder, table, utf8

LEAST, LONGEST, TOP = 30, 4, 2000
SCALE = 2_000_000
#: Most bits of the filter of frequent pairs, which is broadcast (16 MB); with more pairs than it can tell apart, more rows are counted, with the same result.
FILTER_BITS = 1 << 27
#: Different phrases that a task holds before it hands on their sums; memory of a bucket's duckdb.
HELD, MEMORY = 1_200_000, "256MB"
CUT = re.compile(rb"[.,;:!?\n-\r]")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: A task's sums, by language and number of words; what adds pieces (languages, words, multiplicities) to them and tells how many phrases it added.
Held = dict[tuple[str, int], Counter]
Add = Callable[[Held, list[str], list[list[bytes]], list[int]], int]
PIECES, PARTS = "lang string, piece string, times long", "lang string, phrase string, words int, n long"


def _text(values) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text in; a task's different pieces, words parted by one blank, out."""
    held: dict[str, Counter] = defaultdict(Counter)

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, own in held.items():
            yield pa.record_batch([pa.array([lang] * len(own), pa.string()), _text(list(own)), pa.array(list(own.values()), pa.int64())], ["lang", "piece", "times"])
        held.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for lang, text in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                held[lang].update(filter(None, (b" ".join(x.split()) for x in CUT.split(text.translate(LOWER)))))
            if sum(map(len, held.values())) > HELD // 12:
                yield from rows()
    yield from rows()


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece, times: different pieces, each with its number."""
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")
    return docs.select(lang, text).mapInArrow(_pieces, PIECES).groupBy("lang", "piece").agg(F.sum("times").alias("times"))


def _phrase_sums(batches: Iterator[pa.RecordBatch], add: Add) -> Iterator[pa.RecordBatch]:
    """lang, piece, times in; rows of PARTS out: sums of a task's phrases."""
    held: Held = defaultdict(Counter)

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, words), own in held.items():
            yield pa.record_batch([pa.array([lang] * len(own), pa.string()), _text(list(own)), pa.array([words] * len(own), pa.int32()), pa.array(list(own.values()), pa.int64())], ["lang", "phrase", "words", "n"])
        held.clear()

    seen = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            seen += add(held, part.column(0).to_pylist(), [x.split() for x in utf8(part.column(1))], part.column(2).to_pylist())
            if seen > HELD:  # as many phrases as may be new have been added since the last look
                seen = sum(map(len, held.values()))
                if seen > HELD // 2:
                    yield from rows()
                    seen = 0
    yield from rows()


def _add_short(held: Held, langs: list[str], pieces: list[list[bytes]], times: list[int]) -> int:
    """Words and word pairs of the pieces; how many."""
    seen = 0
    for lang, words, n in zip(langs, pieces, times):
        for size, found in ((1, words), (2, [a + b" " + b for a, b in zip(words, words[1:])])):
            own = held[lang, size]
            seen += len(found)
            if n == 1:
                own.update(found)
            else:
                for phrase in found:
                    own[phrase] += n
    return seen


def _add_long(bits: bytes) -> Add:
    """Phrases of three and more words whose every pair is in the filter."""
    filled, mask, digest = np.frombuffer(bits, np.uint8), np.uint64(8 * len(bits) - 1), xxhash.xxh64_intdigest

    def add(held: Held, langs: list[str], pieces: list[list[bytes]], times: list[int]) -> int:
        own = [i for i, words in enumerate(pieces) if len(words) > 2]
        starts = {lang: lang.encode() + b"\t" for lang in set(langs)}
        pairs = [digest(start + a + b" " + b, 42) for i in own for start in (starts[langs[i]],) for a, b in zip(pieces[i], pieces[i][1:])]
        at = np.array(pairs, np.uint64) & mask
        run = (filled[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        lengths = np.array([len(pieces[i]) - 1 for i in own], np.int64)
        piece = np.repeat(np.array(own, np.int64), lengths)
        place = np.arange(len(piece)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        seen = 0
        for n in range(3, LONGEST + 1):
            # Pairs from which on n - 1 in a row are in the filter.
            run = run[:-1] & run[1:] & (piece[: len(run) - 1] == piece[n - 2 : n - 2 + len(run) - 1])
            first = np.flatnonzero(run)
            seen += len(first)
            for i, j in zip(piece[first].tolist(), place[first].tolist()):
                held[langs[i], n][b" ".join(pieces[i][j : j + n])] += times[i]
        return seen

    return add


def _spills(spark: SparkSession) -> str | None:
    """Where tasks spill: below the shared folder, if that is a path; None for the disks that Spark itself spills to."""
    path = shared_folder(spark)
    return f"/{path.removeprefix('file:').lstrip('/')}/spilled" if path.startswith(("file:", "/")) else None


def _bucket_counts(batches: Iterator[pa.RecordBatch], spills: str | None) -> Iterator[pa.RecordBatch]:
    """The frequent phrases of a hash bucket, and for each language the sum of its words in the bucket, as a phrase of no words. What duckdb spills lies in a folder of the task's own and goes with it."""
    import duckdb

    spills = spills or os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    if spills:
        os.makedirs(spills, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=spills) as folder, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False}) as db:
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])
        parts = pa.RecordBatchReader.from_batches(schema, (b.cast(schema) for b in batches))
        db.register("parts", parts)
        db.execute("CREATE TEMP TABLE sums AS SELECT lang, phrase, words, sum(n)::BIGINT AS n FROM parts GROUP BY ALL")
        found = f"SELECT lang, phrase, words, n FROM sums WHERE n >= {LEAST} UNION ALL SELECT lang, '', 0::INT, sum(n)::BIGINT FROM sums WHERE words = 1 GROUP BY lang"
        for batch in db.sql(found).to_arrow_reader(8192):
            yield batch.cast(schema)


def bucket_counts(parts: DataFrame) -> DataFrame:
    """lang, phrase, words, n of frequent phrases, from partial sums."""
    spills = _spills(parts.sparkSession)
    return parts.repartition("lang", "phrase").mapInArrow(lambda batches: _bucket_counts(batches, spills), PARTS)


def _pair_filter(pairs: DataFrame) -> bytes:
    """Bits of the hashes of `pairs`: at least 16 for each pair, up to FILTER_BITS, a power of two."""
    size = 1 << 15
    while size < min(FILTER_BITS, 16 * pairs.count()):
        size *= 2
    at = F.xxhash64(F.concat_ws("\t", "lang", "phrase")).bitwiseAND(F.lit(size - 1).cast("long"))
    # The built-in bitmaps count positions from 1 and buckets of 32768 bits.
    numbered = pairs.select(at.alias("at")).select(F.bitmap_bucket_number(F.col("at") + 1).alias("chunk"), F.bitmap_bit_position(F.col("at") + 1).alias("bit"))
    chunk = 1 << 12
    bits = bytearray(size // 8)
    for row in numbered.groupBy("chunk").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        bits[(row["chunk"] - 1) * chunk : row["chunk"] * chunk] = row["bits"]
    return bytes(bits)


def phrase_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase, words, n: words and phrases that occur LEAST times or more, and rows of no words with the number of all words (in parts)."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/pieces-{uuid.uuid4().hex}"
    pieces(docs).write.option("compression", "zstd").parquet(folder)
    cut = spark.read.parquet(folder)
    short = checkpointed(bucket_counts(cut.mapInArrow(lambda batches: _phrase_sums(batches, _add_short), PARTS)), 200_000)
    shared = spark.sparkContext.broadcast(_pair_filter(short.where("words = 2")))
    long = checkpointed(bucket_counts(cut.mapInArrow(lambda batches: _phrase_sums(batches, _add_long(shared.value)), PARTS)), 200_000)
    return short.unionByName(long.where("words > 2"))


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of every candidate, by its lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = counts.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    asked = F.explode(F.array(F.struct(F.lit(True).alias("first"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("first"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("part")))).alias("ask")
    requests = cuts.select("lang", "phrase", "a", "k", asked).select("lang", "phrase", "a", "k", "ask.*")
    known = counts.where("words > 0").select("lang", F.col("phrase").alias("part"), "n")
    answers = salted_join(requests, known, ["lang", "part"], "phrase", salts=16)
    side = lambda first: F.max(F.when(F.col("first") == first, F.col("n")))
    both = answers.groupBy("lang", "phrase", "k").agg(F.first("a").alias("a"), side(True).alias("l"), side(False).alias("r"))
    score = F.call_function("div", _wide(F.lit(SCALE)) * _wide(F.col("a")), _wide(F.col("l")) + _wide(F.col("r"))).alias("score")
    best = both.select("lang", "phrase", "a", F.struct(score, "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(counts: DataFrame) -> DataFrame:
    """lang, phrase, most: of phrases inside a longer candidate, the highest count of one."""
    spans = [(n, start, length) for n in range(3, LONGEST + 1) for length in range(2, n) for start in range(1, n - length + 2)]
    w = F.split("phrase", " ")
    inside = F.array_compact(F.array(*(F.when(F.col("words") == n, F.array_join(F.slice(w, start, length), " ")) for n, start, length in spans)))
    longer = counts.where("words > 2").select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), "n")
    return longer.groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language, with `rank`: slices of the order, counted, tell where each slice's ranks begin, so no task orders a whole language."""
    order = [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")]
    sliced = checkpointed(rows.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), 200_000)
    here = sliced.groupBy("lang", "slice").agg(F.count("*").alias("here"))
    before = F.sum("here").over(Window.partitionBy("lang").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    here = here.select("lang", "slice", F.coalesce(before, F.lit(0)).alias("before")).where(F.col("before") < top)  # a row for each language and slice at most
    within = F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order[1:]))
    out = sliced.join(F.broadcast(here), ["lang", "slice"]).withColumn("rank", F.col("before") + within)
    return out.where(F.col("rank") <= top).drop("slice", "before")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    counts = checkpointed(phrase_counts(docs), 200_000)
    kept = scored(counts).join(covered(counts), ["lang", "phrase"], "left")
    kept = kept.where(F.col("most").isNull() | (_wide(F.col("most")) * 100 < _wide(F.col("a")) * 80)).drop("most")
    totals = counts.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    # A row for each language.
    out = ranked(kept, top).join(F.broadcast(totals), "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH cut AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w, count(*) AS times FROM cut GROUP BY ALL),
lengths AS (SELECT unnest(range(1, 5)) AS words),
grams AS (SELECT lang, words, times, unnest(list_transform(range(1, len(w) - words + 2), lambda i: array_to_string(w[i:i + words - 1], ' '))) AS phrase FROM worded, lengths WHERE len(w) >= words),
counts AS MATERIALIZED (SELECT lang, words, phrase, sum(times)::HUGEINT AS n FROM grams GROUP BY ALL HAVING sum(times) >= 30),
totals AS (SELECT lang, sum(len(w) * times)::BIGINT AS n FROM worded GROUP BY lang),
cuts AS (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k FROM counts WHERE words > 1),
scores AS (SELECT c.lang, c.phrase, c.a, l.n AS l, r.n AS r, k, 2000000 * c.a // (l.n + r.n) AS score FROM cuts c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, n, unnest(flatten(list_transform(range(2, words), lambda m: list_transform(range(1, words - m + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' '))))) AS phrase FROM counts WHERE words > 2),
gone AS (SELECT b.lang, b.phrase FROM best b JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE 100 * i.n >= 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, t.n, score::BIGINT AS score
FROM best JOIN totals t USING (lang) WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM gone) QUALIFY rank <= 2000
"""
