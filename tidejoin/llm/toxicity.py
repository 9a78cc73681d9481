"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers are composed into one machine: reported speech, negation, target, insult and threat. Each reads a clause as symbols (insult,
threat, target, negation, reporting word, other) and hands on the symbols with what it has found out: an insult after a
reporting word is reported, one shortly after a negation is negated, one near a target is aimed; a threat counts only if it is aimed. The last two turn
what is left into clause matches with weights. A target may follow: a sixth transducer reads the clause from its end and marks insults and threats
that have one shortly after them, before the machine reads it from its start. A reporting word reaches over commas and colons. Texts are scored by their matched clauses, never by words alone: the sum of the clauses' weights
and their number go into a logistic model.

Insults are lexemes (words, or stems of 3 to 8 letters) that documents labelled toxic have and others lack, by a likelihood-ratio test over
all words and stems of the training documents; a lexeme's weight is its log odds, a threat word's too if it is one. Threats, targets, negations and reporting words are short fixed lists in
four languages. Lexicon and logistic model are fitted on at most `TRAIN_ROWS` labelled documents, those with the smallest hashes of doc_id, without near copies.

An Aho-Corasick automaton finds the lexemes, so only clauses that have one are read by the machine; a clause with neither an insult nor a
threat has no accepting path.

Defined results: a null text is the empty text; a text without matched clauses gets the score that the model gives to that, empty texts
too; without labelled rows all scores are 0; labels above 0 are toxic, and with one kind of label only all texts get its smoothed rate; if several rows of labels have one doc_id, the largest label counts;
where too few documents are labelled for the test, no lexeme is learned, and texts are told apart by threats only; a very long text is scored whole, clause by clause; repeated rows get a row each; other columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, map_slices, remainder, table, utf8
from .ngram_join import _functions as functions_of
from .ngram_join import minima, ngrams

TRAIN_ROWS = 20_000
STEMS = (3, 4, 5, 6, 7, 8)
LEAST_ODDS = 4.5
#: How many times the documents of its most frequent word a stem must have.
STEM_GAIN = 1.1
#: Words of each kind in English, German, French and Spanish, in their usual forms.
THREATS = (
    "kill kills killing killed hurt hurts hurting destroy destroys destroying shoot shoots shooting stab stabs stabbing murder murders murdering strangle strangling slaughter "
    "töten töte tötet umbringen bringe schlagen schlage erschießen erstechen verletzen verprügeln ermorden tuer tue tuerai frapper frapperai détruire assassiner étrangler égorger "
    "matar mato mataré golpear golpearé destruir asesinar apuñalar estrangular"
).split()
TARGETS = (
    "you your yours yourself yourselves ya du dich dir dein deine deinen deiner deinem euch euer eure ihr tu te toi ton ta tes vous votre vos tú ti tu usted ustedes vosotros vosotras os vuestro vuestra"
).split()
NEGATIONS = (
    "not no never nor cannot isn aren wasn weren don doesn didn won wouldn shouldn couldn hasn haven nicht kein keine keinen nie niemals weder pas jamais aucun aucune ni nunca jamás tampoco ningún ninguna sin"
).split()
REPORTS = (
    "said says saying wrote writes quoted quotes claimed claims alleged alleges reported reports told tells replied sagte sagt schrieb schreibt zitiert laut angeblich behauptete meldete "
    "dit écrit affirmé selon prétend cite dijo dice escribió afirmó según citó"
).split()
KINDS = {w: k for k, words in (("target", TARGETS), ("not", NEGATIONS), ("report", REPORTS)) for w in words}
SYMBOLS = ("insult", "threat", "target", "not", "report", "other", "faced insult", "faced threat")
#: How many words a negation, and a target, reaches.
NOT_REACH, TARGET_REACH = 3, 4
MARKED = {"aimed": 1.5, "insult": 1.0, "reported": 0.5, "negated": 0.25}

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[^.!?;:,\n]+")
#: What ends a sentence, and the reach of a reporting word.
ENDS = ".!?;\n"


class Transducer:
    """arcs[state][symbol] = (symbol handed on, weight, next state); 0 is the start, and a symbol without an arc is handed on as it is."""

    def __init__(self, arcs: dict):
        self.arcs = arcs

    def step(self, state, symbol: str) -> tuple:
        return self.arcs.get(state, {}).get(symbol, (symbol, 1.0, state))

    def compose(self, then: Transducer, symbols: tuple[str, ...] = SYMBOLS) -> Transducer:
        """Both in turn, over the states that can be reached on `symbols`."""
        numbers, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
        while todo:
            a, b = pair = todo.pop()
            row = arcs.setdefault(numbers[pair], {})
            for symbol in symbols:
                between, w1, a2 = self.step(a, symbol)
                out, w2, b2 = then.step(b, between)
                if (a2, b2) not in numbers:
                    numbers[a2, b2] = len(numbers)
                    todo.append((a2, b2))
                row[symbol] = (out, w1 * w2, numbers[a2, b2])
        return Transducer(arcs)


def _reported() -> Transducer:
    return Transducer({0: {"report": ("other", 1.0, 1)}, 1: {"insult": ("reported", 1.0, 1), "threat": ("other", 1.0, 1), "faced insult": ("reported", 1.0, 1), "faced threat": ("other", 1.0, 1)}})


def _counting(trigger: str, reach: int, change: dict[str, str], kept: tuple[str, ...]) -> Transducer:
    """After `trigger`, changes symbols for `reach` words."""
    fall = {s: (s, 1.0, 0) for s in (*SYMBOLS, *kept)}
    arcs = {0: {trigger: (trigger, 1.0, reach)}}
    for left in range(reach, 0, -1):
        arcs[left] = {s: (o, w, left - 1) for s, (o, w, _) in fall.items()} | {s: (o, 1.0, left - 1) for s, o in change.items()} | {trigger: (trigger, 1.0, reach)}
    return Transducer(arcs)


def following() -> Transducer:
    """Reads a clause from its end: what has a target within TARGET_REACH words after it faces it."""
    return _counting("target", TARGET_REACH, {"insult": "faced insult", "threat": "faced threat"}, ())


def grammar() -> Transducer:
    """reported speech . negation . target . insult . threat"""
    negation = _counting("not", NOT_REACH, {"insult": "negated", "threat": "other", "faced insult": "negated", "faced threat": "other"}, ("reported",))
    target = _counting("target", TARGET_REACH, {"insult": "aimed", "threat": "aimed threat"}, ("reported", "negated"))
    insult = Transducer({0: {k: ("match", w, 0) for k, w in (MARKED | {"faced insult": MARKED["aimed"]}).items()}})
    threat = Transducer({0: {"aimed threat": ("match", 1.5, 0), "faced threat": ("match", 1.5, 0)}})
    machine = _reported()
    for then in (negation, target, insult, threat):
        machine = machine.compose(then)
    return machine


class Lexicon:
    """Finds the words of a text that are lexemes: (place, kind, weight)."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.find = ahocorasick.Automaton()
        entries = {w: ("threat", 1.0, True) for w in THREATS} | {s: ("insult", v, False) for s, v in stems.items()}
        for w, v in words.items():
            if w not in entries or entries[w][0] == "threat" or entries[w][1] < v:
                entries[w] = ("insult", v, True)
        for w, entry in entries.items():
            self.find.add_word(w, (len(w), *entry))
        self.find.make_automaton()

    def hits(self, low: str) -> dict[int, tuple[str, float]]:
        out: dict[int, tuple[str, float]] = {}
        for end, (n, kind, weight, whole) in self.find.iter(low):
            at = end + 1 - n
            if at and (low[at - 1].isalpha()):
                continue
            if whole and end + 1 < len(low) and low[end + 1].isalpha():
                continue
            # What labels say comes before the fixed list of threats.
            if at not in out or (out[at][0] == "insult", out[at][1]) < (kind == "insult", weight):
                out[at] = (kind, weight)
        return out


def clause_scores(text: str | None, lexicon: Lexicon, machine: Transducer, ahead: Transducer | None = None) -> list[float]:
    """The weights of the clauses that the grammar matches; a word that several clauses have counts in the one where it weighs most.

    ahead: what following() gives; without it a target counts only if it comes first.
    """
    low = (text or "").lower()
    hits = lexicon.hits(low)
    if not hits:
        return []
    best: dict[str, tuple[float, int]] = {}
    places = sorted(hits)
    at = read = 0
    reported = False
    for n, clause in enumerate(CLAUSE.finditer(low)):
        if at == len(places):
            break
        if clause.end() <= places[at]:
            continue
        while at < len(places) and places[at] < clause.end():
            at += 1
        # Whether the sentence had a reporting word in the clauses before: the last one read, and those without lexemes.
        end = max(low.rfind(c, read, clause.start()) for c in ENDS)
        reported = reported and end < 0 or any(KINDS.get(w) == "report" for w in WORD.findall(low, max(end, read), clause.start()))
        read = clause.end()
        words = [(w[0], *(hits.get(w.start()) or (KINDS.get(w[0], "other"), 0.0))) for w in WORD.finditer(low, clause.start(), clause.end())]
        symbols = [symbol for _, symbol, _ in words]
        if ahead:
            state = 0
            for i in range(len(symbols) - 1, -1, -1):
                symbols[i], _, state = ahead.step(state, symbols[i])
        state = machine.step(0, "report")[2] if reported else 0
        for (word, kind, weight), symbol in zip(words, symbols):
            reported = reported or kind == "report"
            said, factor, state = machine.step(state, symbol)
            if said == "match":
                best[word] = max(best.get(word, (0.0, n)), (factor * weight, n))
    out: dict[int, float] = {}
    for score, n in best.values():
        out[n] = out.get(n, 0.0) + score
    return list(out.values())


def features(texts: list[str | None], lexicon: Lexicon, machine: Transducer, ahead: Transducer) -> np.ndarray:
    scores = [clause_scores(t, lexicon, machine, ahead) for t in texts]
    return np.array([[1.0, np.log1p(sum(s)), np.log1p(len(s))] for s in scores]).reshape(-1, 3)


def _lexemes(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return {f"={w}" for w in words} | {w[:n] for w in words for n in STEMS if len(w) > n}


def without_copies(rows: DataFrame) -> DataFrame:
    """text, toxic without near copies, which would lend all their words to a class: a text goes if others come before it under two or more of four minima over its word n-grams."""
    functions = functions_of(4)

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = np.stack([minima(ngrams(x), *functions) for x in utf8(batch.column(1))]).astype(np.int64)
        return pa.record_batch([batch.column(0), *(pa.array(own[:, k]) for k in range(4))], ["row", "m0", "m1", "m2", "m3"])

    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()), 2_000)
    keys = map_slices(rows.select("row", "text"), sign, "row long, m0 long, m1 long, m2 long, m3 long")
    keys = checkpointed(keys.select("row", F.posexplode(F.array("m0", "m1", "m2", "m3")).alias("k", "m")))
    firsts = keys.groupBy("k", "m").agg(F.min("row").alias("row")).groupBy("row").agg(F.count("*").alias("first"))
    return rows.join(firsts.where("first >= 3").select("row"), "row", "left_semi").select("text", "toxic")


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """rows: text, toxic; no more than `fit` takes, so what passes the test is bounded by its parameter."""

    def count(batches):
        found = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[toxic].update(_lexemes(text or ""))
        # What toxic documents lack in this part may still be in others' counts, so all goes on.
        names = list(found[0] | found[1])
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.record_batch([pa.array(part), *(pa.array([c[x] for x in part], pa.int64()) for c in found)], ["lexeme", "clean", "toxic"])

    docs = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = docs.get(0, 0), docs.get(1, 0)
    if not clean or not toxic:
        return Lexicon({}, {})
    counts = rows.select("text", "toxic").mapInArrow(count, "lexeme string, clean long, toxic long").groupBy("lexeme").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("toxic >= 3")
    total = clean + toxic
    n = F.col("clean") + F.col("toxic")
    term = lambda c, part: F.when(c > 0, c * F.log(c * total / (n * part))).otherwise(0.0)
    rest = lambda c, part: F.when(c < part, (part - c) * F.log((part - c) * total / ((total - n) * part))).otherwise(0.0)
    ratio = 2 * (term(F.col("toxic"), toxic) + term(F.col("clean"), clean) + rest(F.col("toxic"), toxic) + rest(F.col("clean"), clean))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    counts = checkpointed(counts.select("lexeme", "toxic", ratio.alias("ratio"), odds.alias("odds")))
    bar = 2 * np.log(max(counts.count(), 1)) + 8
    kept = counts.where((F.col("ratio") > bar) & (F.col("odds") > LEAST_ODDS)).collect()
    weights = {r["lexeme"]: min(r["odds"], 8.0) / 8 for r in kept}
    # A stem says more than a word only if documents have it in different words.
    largest: Counter = Counter()
    for r in kept:
        if r["lexeme"][0] == "=":
            for n in STEMS:
                largest[r["lexeme"][1 : n + 1]] = max(largest[r["lexeme"][1 : n + 1]], r["toxic"])
    stems = {r["lexeme"] for r in kept if r["lexeme"][0] != "=" and r["toxic"] > STEM_GAIN * largest[r["lexeme"]]}
    return Lexicon({k[1:]: v for k, v in weights.items() if k[0] == "="}, {k: v for k, v in weights.items() if k in stems})


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Coefficients by Newton's method; the intercept isn't shrunk."""
    b = np.zeros(x.shape[1])
    shrink = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


class ToxicityModel:
    """A lexicon and the coefficients for matched clauses."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], b: np.ndarray | None):
        self.parts = (words, stems, b)
        self.ready: tuple | None = None

    def __getstate__(self):
        return self.parts

    def __setstate__(self, parts):
        self.parts, self.ready = parts, None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        words, stems, b = self.parts
        if b is None:
            return np.zeros(len(texts))
        if not self.ready:
            self.ready = Lexicon(words, stems), grammar(), following()
        return 1 / (1 + np.exp(-features(texts, *self.ready) @ b))


def fit(docs: DataFrame, labels: DataFrame, learn: F.Column, most: int = TRAIN_ROWS) -> ToxicityModel:
    """learn: which rows of labels may be learned from; toxic null never is."""
    rows = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sample = checkpointed(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    # No more than `most` rows, so the broadcast is bounded.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic")
    rows = checkpointed(without_copies(rows), 2_000)
    lexicon = learn_lexicon(rows)
    words, stems = {}, {}
    for w in lexicon.find.keys():
        _, kind, weight, whole = lexicon.find.get(w)
        if kind == "insult":
            (words if whole else stems)[w] = weight
    held = ToxicityModel(words, stems, None)

    def see(batches):
        parts = held.parts[:2]
        ready = Lexicon(*parts), grammar(), following()
        for batch in batches:
            x = features(batch.column(0).to_pylist(), *ready)
            yield pa.record_batch([pa.array(x[:, 1]), pa.array(x[:, 2]), batch.column(1)], ["a", "b", "toxic"])

    seen = rows.mapInArrow(see, "a double, b double, toxic int").groupBy("a", "b", "toxic").agg(F.count("*").alias("n")).collect()
    if not seen:
        return held
    n = np.array([r["n"] for r in seen])
    x = np.repeat(np.array([[1.0, r["a"], r["b"]] for r in seen]), n, axis=0)
    y = np.repeat(np.array([float(r["toxic"]) for r in seen]), n)
    if y.min() == y.max():  # one class says nothing of clauses
        return ToxicityModel(words, stems, np.array([np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0, 0.0]))
    return ToxicityModel(words, stems, logistic(x, y))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score_documents(docs: DataFrame, model: ToxicityModel, held_out: F.Column) -> DataFrame:
    """A row per document, as SCHEMA says."""

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.scores(batch.column(2).to_pylist())
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [x.split()[0] for x in SCHEMA.split(", ")])

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text")), score, SCHEMA)


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents that score below 0.5, columns as they are."""

    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield part.filter(pa.array(model.scores(part.column(at).to_pylist()) < 0.5))

    # By number, as a column may have any name.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, part = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 5)
    return score_documents(docs, fit(docs, labels, part != 0), part == 0)
