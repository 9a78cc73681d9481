r"""How far the sources of a language are from one another, and which terms mark each: triangular divergence of smoothed term shares, in whole numbers.

Each language keeps the terms that at least ten of its documents have. A group, the documents of one language and source, gives each kept term the share p = 1 + floor(10**9 (c + 2) / (N + 2 V)), c its count there,
N all counts there, V the number of kept terms; a pair of groups is worth the sum of f(p, q) = floor((p - q)**2 / (p + q)) over all kept terms.

Most terms of the sum are absent from one group or from both, so it is taken by supports, with inclusion and exclusion:
  - terms of one group, priced against the other's share of an absent term: by the group's histogram of counts, which has few rows however many terms it stands for;
  - terms that neither has: a constant, V less both supports;
  - terms that both have, for which both prices and the constant above are wrong: a join of the postings (term, group, count) by term gives the correction, summed up by pair before the shuffle.
f is the same both ways, so a pair of groups is computed once.

Defined results: A-Z count as lower case, terms are runs of letters A-Z and of all characters beyond ASCII; a null text, language or source is ''; a group without terms has a row for each other source of its language, 0 where the language keeps no term;
a language with one source has no pair rows; ties of value go by the item's bytes; repeated rows are documents each; a very long text is read whole; an empty table gives an empty result. Other columns, doc_id among them, aren't read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table, utf8, with_bounded

LEAST_DOCUMENTS, SHARES, TOP = 10, 1_000_000_000, 10
#: Different terms of its groups that a task counts before it hands them on.
HELD = 700_000
SPACED = bytes(c if c >= 0x80 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text in; rows of COUNTS out, and one with an empty term for each group."""
    words: dict = defaultdict(Counter)
    docs: dict = defaultdict(Counter)

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in words.items():
            terms = [b"", *own]
            same = lambda x: pa.array([x] * len(terms), pa.string())
            n, d = [0, *own.values()], [0, *(docs[lang, source][t] for t in terms[1:])]
            yield pa.record_batch([same(lang), same(source), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "n", "docs"])
        words.clear(), docs.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part.column(2))):
                found = text.translate(SPACED).split()
                words[lang, source].update(found)
                docs[lang, source].update(set(found))
            if sum(map(len, words.values())) > HELD:
                yield from rows()
    yield from rows()


def postings(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it); a row with an empty term for each group."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    parts = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_count, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _wide(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("decimal(20,0)")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 (count + 2) / (total + 2 kept)), exact beyond 64 bits; null where there is nothing to divide by."""
    return F.call_function("div", _wide(SHARES) * _wide(count + 2), F.nullif(_wide(total + 2 * kept), F.lit(0).cast("decimal(20,0)"))) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); shares are at most 10**9 + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _statistics(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept postings: lang, source, term, n, everywhere (the term's count in the language). Groups: lang, source, total, support, kept (V of the language), lang_total; their number is that of the groups."""
    posts = checkpointed(postings(docs), 200_000)
    term = Window.partitionBy("lang", "term")
    held = posts.where("term <> ''").withColumn("docs", F.sum("docs").over(term)).where(F.col("docs") >= LEAST_DOCUMENTS)
    held = checkpointed(held.select("lang", "source", "term", "n", F.sum("n").over(term).alias("everywhere")), 200_000)
    own = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    langs = held.groupBy("lang", "term").agg(F.first("everywhere").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = posts.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *map(zero, ("total", "support", "kept", "lang_total")))
    return held, checkpointed(groups.withColumn("none", share(F.lit(0), F.col("total"), F.col("kept"))))


def pair_values(held: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value for each two sources a < b of a language."""
    few = groups.count()
    priced = with_bounded(held, groups.select("lang", "source", "total", "kept", "none"), ["lang", "source"], few, how="inner")
    priced = priced.select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), "none")
    sided = lambda df, x: df.select("lang", *(["term"] if "term" in df.columns else []), *(F.col(c).alias(f"{c}_{x}") for c in df.columns if c not in ("lang", "term")))
    ends = [sided(groups.select("lang", "source", "support", "kept", "none"), x) for x in "ab"]
    neither = ends[0].join(ends[1], "lang").where("source_a < source_b")
    pair = ["lang", F.col("source_a").alias("a"), F.col("source_b").alias("b")]
    constant = (F.col("kept_a") - F.col("support_a") - F.col("support_b")) * apart(F.col("none_a"), F.col("none_b"))
    parts = [neither.select(*pair, F.coalesce(constant, F.lit(0)).alias("value"))]
    # One side's terms against the other's share of an absent term.
    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    against = histogram.join(groups.select("lang", F.col("source").alias("other"), F.col("none").alias("q")), "lang").where("source <> other")
    parts.append(against.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (F.col("terms") * apart(F.col("p"), F.col("q"))).alias("value")))
    # Terms of both.
    left, right = (sided(priced.drop("n"), x) for x in "ab")
    both = left.join(right, ["lang", "term"]).where("source_a < source_b")
    p, q, p0, q0 = map(F.col, ("p_a", "p_b", "none_a", "none_b"))
    parts.append(both.select(*pair, (apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0)).alias("value")))
    sums = [x.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for x in parts]
    return sums[0].unionAll(sums[1]).unionAll(sums[2]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def marking_terms(held: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: of each group, the kept terms with the highest values of those it has a larger share of than its language has."""
    rows = with_bounded(held, groups.drop("support", "none"), ["lang", "source"], groups.count(), how="inner")
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("everywhere"), F.col("lang_total"), F.col("kept"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    rows = rows.select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    held, groups = _statistics(docs)
    pairs = checkpointed(pair_values(held, groups))
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionAll(pairs.select("lang", "b", "a", "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    return pairs.unionByName(marking_terms(held, groups).withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
places AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM places GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counted AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM places JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS everywhere FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM grid GROUP BY ALL),
shares AS (SELECT g.*, 1 + (1000000000::HUGEINT * (n + 2)) // (t.total + 2 * s.v) AS p, 1 + (1000000000::HUGEINT * (everywhere + 2)) // (s.total + 2 * s.v) AS q
  FROM grid g JOIN totals t USING (lang, source) JOIN sizes s ON s.lang = g.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM every QUALIFY part = 'pair' OR rank <= 10
"""
