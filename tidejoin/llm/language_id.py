"""Language identification by interpolated Kneser-Ney character models.

A text's words are its runs of letters, lower-cased; a model sees each word between boundary marks, so a text's score is a sum
over its words. For each language, modified counts of all n-grams up to `ORDER` characters give an interpolated
Kneser-Ney model: raw counts at the highest order, continuation counts (different left neighbours) below, one absolute discount for each order,
and beneath the unigrams a uniform distribution over the characters that any language has and one unseen. An n-gram is a 64-bit hash; each order has one sorted array of the hashes
that any language has seen, beside a matrix of log-probabilities and back-off weights, a column for each language.

The language with the lowest cross-entropy, normalised by the number of predicted characters, is chosen. The posterior (from the entropies' differences,
scaled by a temperature) is the score. The temperature is fitted to the calibration texts (training documents that the counts leave out), by their likelihood with smoothed targets.
A text is rejected if its entropy is above what a share `REJECT` of texts of the chosen language have, by a log-normal fit to its calibration texts; `reject=True` makes such texts `und`, and the column `accepted` tells them otherwise.

The models are fitted on at most `PER_LANGUAGE` different labelled texts of each language, those with the smallest hashes; whole texts are counted.

Defined results: a null text, or one without letters, is `und` with score 0; with nothing to learn from, every text is `und`; ties go to the smaller
language name; repeated rows get a row each; a very long text is scored whole, word by word; rows without lang aren't learned from; other columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, map_slices, remainder, table

ORDER = 5
PER_LANGUAGE = 500
DISCOUNT = 0.75
#: Temperatures to choose from, in bits a character.
TEMPERATURES = np.geomspace(0.005, 2.0, 60)
REJECT = 0.999
#: Words whose log-probabilities a Python worker keeps.
KEPT_WORDS = 300_000
WORD = re.compile(r"[^\W\d_]+")
EDGE = "\x02"


def _hashes(chars: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of code points."""
    h = np.full(chars.shape[0], 0x9E3779B97F4A7C15, np.uint64)
    for i in range(chars.shape[1]):
        h = (h ^ chars[:, i].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words as one array, each with ORDER - 1 marks before it and one after; the places of predicted characters, in order."""
    before = EDGE * (ORDER - 1)
    joined = "".join(f"{before}{w}{EDGE}" for w in words)
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + ORDER)[:-1]]) + ORDER - 1 if len(words) else np.zeros(0, np.int64)
    n = lengths + 1
    places = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(words) else np.zeros(0, np.int64)
    return chars, places


def _grams(chars: np.ndarray, places: np.ndarray, n: int, end: int = 0) -> np.ndarray:
    """Hashes of the n characters that end `end` before each place."""
    return _hashes(np.stack([chars[places - end - i] for i in range(n - 1, -1, -1)], axis=1)) if n else np.zeros(len(places), np.uint64)


class Models:
    """Kneser-Ney models of all languages in sorted hash arrays."""

    def __init__(self, counts: dict[str, Counter]):
        self.langs = sorted(counts)
        k = len(self.langs)
        self.keys: list[np.ndarray] = []
        self.logs: list[np.ndarray] = []
        self.context_keys: list[np.ndarray] = []
        self.backs: list[np.ndarray] = []
        self.calibration, self.temperature = np.full(k, np.inf), float(TEMPERATURES[-1])
        per = []
        for lang in self.langs:
            words = list(counts[lang])
            chars, places = _code_points(words)
            times = np.repeat(np.fromiter(counts[lang].values(), np.float64), np.fromiter(map(len, words), np.int64) + 1)
            per.append(self._estimate(chars, places, times))
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([p[n][0] for p in per])) if per else np.zeros(0, np.uint64)
            contexts = np.unique(np.concatenate([p[n][3] for p in per])) if per else np.zeros(0, np.uint64)
            direct, back = np.zeros((len(keys), k)), np.ones((len(contexts), k))
            for j, p in enumerate(per):
                direct[np.searchsorted(keys, p[n][0]), j] = p[n][2]
                back[np.searchsorted(contexts, p[n][3]), j] = p[n][4]
            self.keys.append(keys)
            self.logs.append(direct)
            self.context_keys.append(contexts)
            self.backs.append(back)
        self.symbols = len(self.keys[0]) + 1

    @staticmethod
    def _estimate(chars, places, times) -> dict[int, tuple]:
        """For each order: n-grams, their contexts, discounted probabilities, contexts, back-off weights."""
        out = {}
        for n in range(ORDER, 0, -1):
            grams = _grams(chars, places, n)
            if n == ORDER:
                keys, first, inverse = np.unique(grams, return_index=True, return_inverse=True)
                count = np.bincount(inverse, times)
            else:  # different n-grams one longer
                longer, at = np.unique(_grams(chars, places, n + 1), return_index=True)
                keys, first, inverse = np.unique(grams[at], return_index=True, return_inverse=True)
                count, first = np.bincount(inverse).astype(float), at[first]
            contexts = _grams(chars, places[first], n - 1, 1)
            unique, where = np.unique(contexts, return_inverse=True)
            total = np.bincount(where, count)
            out[n] = (keys, contexts, np.maximum(count - DISCOUNT, 0) / total[where], unique, np.minimum(DISCOUNT * np.bincount(where) / total, 1))
        return out

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """log2 probability of each word under each language."""
        chars, places = _code_points(words)
        logs = np.log2(np.maximum(self.probabilities(chars, places), 1e-12))
        n = np.fromiter(map(len, words), np.int64, len(words)) + 1
        return np.add.reduceat(logs, np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0)

    def probabilities(self, chars: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of the character at each place, after those before it, under each language."""
        p = np.full((len(places), len(self.langs)), 1 / self.symbols)
        for n in range(1, ORDER + 1):
            back = self._look(self.context_keys[n - 1], self.backs[n - 1], _grams(chars, places, n - 1, 1), 1.0)
            p = self._look(self.keys[n - 1], self.logs[n - 1], _grams(chars, places, n), 0.0) + back * p
        return p

    def calibrate(self, langs: list[str], bits: np.ndarray) -> None:
        """Temperature and rejection from texts of known languages and their entropies."""
        true = np.array([self.langs.index(x) for x in langs], np.int64)
        n, k = bits.shape
        if not n:
            return
        for j in range(k):
            if (true == j).any():
                own = np.log(np.maximum(bits[true == j, j], 1e-6))
                self.calibration[j] = np.exp(own.mean() + NormalDist().inv_cdf(REJECT) * own.std(ddof=1 if len(own) > 1 else 0))
        target = np.full((n, k), 1 / (n + k))
        target[np.arange(n), true] = (n + 1) / (n + k)
        loss = []
        for t in TEMPERATURES:
            x = -bits / t
            loss.append(-(target * (x - np.logaddexp.reduce(x, axis=1, keepdims=True))).sum())
        self.temperature = float(TEMPERATURES[int(np.argmin(loss))])

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, absent: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        found = values[at]
        found[keys[at] != wanted] = absent
        return found


class Scorer:
    """Log-probabilities of texts, with those of many words kept."""

    def __init__(self, models: Models):
        self.models, self.index, self.kept = models, {}, np.zeros((1024, len(models.langs)))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits a character under each language, and how many characters were predicted."""
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for ws in words for w in ws]
        if len(self.index) > KEPT_WORDS:
            self.index = {}
        new = list({w for w in flat if w not in self.index})
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            base = len(self.index)
            if base + len(part) > len(self.kept):
                self.kept = np.concatenate([self.kept, np.zeros((max(len(self.kept), len(part)), self.kept.shape[1]))])
            self.kept[base : base + len(part)] = self.models.log_probabilities(part)
            self.index.update(zip(part, range(base, base + len(part))))
        ids = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        lengths = np.fromiter(map(len, flat), np.int64, len(flat)) + 1
        text = np.repeat(np.arange(len(texts)), n)
        chars = np.bincount(text, lengths, len(texts))
        sums = np.stack([np.bincount(text, self.kept[ids, j], len(texts)) for j in range(self.kept.shape[1])], axis=1)
        return -sums / np.maximum(chars, 1)[:, None], chars


def training_rows(docs: DataFrame, learn: F.Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang, text and a hash of it: of each language, at most per_language documents that `learn` admits, by smallest hash."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = F.xxhash64("text").alias("order")
    # A threshold keeps what is shuffled to about the bound; ranks then make it exact.
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    near = F.lit(False)
    for lang, n in counts.items():
        part = min(1.0, 2 * per_language / n + 50 / n)
        near = near | ((F.col("lang") == lang) & (F.xxhash64("text") <= F.lit(int(-(2**63) + part * (2**64 - 1)) if part < 1 else 2**63 - 1)))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    texts = rows.where(near).groupBy("lang", order).agg(F.min("text").alias("text"))
    return texts.withColumn("n", first).where(F.col("n") <= per_language).select("lang", "text", "order")


def fit(docs: DataFrame, learn: F.Column, per_language: int = PER_LANGUAGE) -> Models:
    """The models of the languages of the rows that `learn` admits."""

    def count(batches):
        for batch in batches:
            found: dict[tuple[str, int], Counter] = {}
            for lang, text, order in zip(*(c.to_pylist() for c in batch.columns)):
                # Every tenth document, by hash, calibrates: it is not counted.
                held = order % 10 == 0
                if not held:
                    found.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            if rows:
                yield pa.record_batch([pa.array(x) for x in zip(*rows)], ["lang", "word", "n"])

    rows = checkpointed(training_rows(docs, learn, per_language), 500)
    counts: dict[str, Counter] = {}
    for lang, word, n in rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(lang, Counter())[word] = n
    models = Models(counts)
    if models.langs:
        held = [(r["lang"], r["text"]) for r in rows.where("order % 10 = 0").toLocalIterator()]
        bits, chars = Scorer(models).entropies([t for _, t in held])
        some = chars > 0
        models.calibrate([x for (x, _), c in zip(held, some) if c and x in models.langs], bits[[c and x in models.langs for (x, _), c in zip(held, some)]])
    return models


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, entropy double, accepted boolean"


def identify(docs: DataFrame, learn: F.Column, held_out: F.Column, reject: bool = False, per_language: int = PER_LANGUAGE) -> DataFrame:
    """A row per document, as SCHEMA says. learn: which rows may be learned from."""
    models = fit(docs, learn, per_language)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    scorer: list[Scorer] = []

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not scorer:
            scorer.append(Scorer(shared.value))
        models, n = shared.value, batch.num_rows
        lang, score, entropy, accepted = ["und"] * n, np.zeros(n), [None] * n, np.zeros(n, bool)
        if models.langs:
            bits, chars = scorer[0].entropies(batch.column(2).to_pylist())
            best = bits.argmin(axis=1)
            lowest = bits[np.arange(n), best]
            weight = np.exp(-(bits - lowest[:, None]) / models.temperature)
            score = np.where(chars > 0, 1 / weight.sum(axis=1), 0.0)
            accepted = (chars > 0) & (lowest <= models.calibration[best])
            lang = [models.langs[j] if c and (a or not reject) else "und" for j, c, a in zip(best, chars, accepted)]
            entropy = [float(e) if c else None for e, c in zip(lowest, chars)]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(lang), pa.array(score), pa.array(entropy, pa.float64()), pa.array(accepted)], [x.split()[0] for x in SCHEMA.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_slices(rows, predict, SCHEMA)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = remainder("doc_id", 4)
    return identify(docs, part != 2, part == 2)
