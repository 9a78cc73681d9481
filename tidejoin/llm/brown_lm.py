"""Language-model scoring by Brown class-based n-grams.

P(text) = product over tokens of P(class | class before) * P(token | class). Tokens are lower-cased (A-Z) words and one end per text.

Every word with `LEAST` or more occurrences in the training texts has a class by exchange. The core, the most frequent words (their number grows with
the vocabulary, see `core_size`), is clustered first: words start in turn in the classes, and each in turn moves to the class that raises the mutual information of adjoining
classes most, until none moves; words outside the core and the start of a text are two fixed neighbours. Then all other words go, each for itself, to the class where the
same gain is highest over the core's counts: a step of exchange for the whole vocabulary, from each word's counts of neighbouring classes. Rarer words and unseen ones share one class more.
Class transitions are counted over all training texts with all words in their classes, and smoothed with the class frequencies. A token's
emission is (c + 0.5) / (its class's tokens + 0.5 * (the class's distinct tokens + 1)).

What is gathered grows with the corpus: counts and classes of all words stay in tables. The `HEAD` most frequent tokens are known to every task (a
broadcast that this parameter bounds), all others are looked up by a join with a hash of the token. A token that many texts have is of the head, so no key of that join is hot;
HEAD decides about the way, not about the result. The driver holds the core's bigrams and what is counted by class.

The base score is that of add-half unigrams over the same counts: the sum over tokens of log10((c + 0.5) / (N + 0.5 * (V + 1))).

Defined results: a null or wordless text has one token, the end; with nothing to learn from N and V are 0, so every token has probability 1 in the base and
in the model; a very long text is one row like any other, of two bytes a token; repeated rows get a row each; ties in counts go by the token's hash, ties in gain to the first class;
other columns aren't read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, checkpointed, remainder, table, utf8

#: So many places, and NONE for no place, are two bytes.
HEAD, NONE = 65_000, 65_535
CLASSES = 60
#: Fewest occurrences of a word with a class of the exchange.
LEAST = 2
#: Words that a Python worker keeps.
KEPT_WORDS = 400_000
#: Weight of the class frequencies in a class transition.
SMOOTH = 5.0
#: A token that no word is, as words have no white space.
END = b"\n"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tokens(text: bytes) -> list[bytes]:
    return [*text.translate(LOWER).split(), END]


def _key(token: bytes) -> int:
    """63 bits of a hash, as a number below 0."""
    return -1 - (xxhash.xxh3_64_intdigest(token) >> 1)


def core_size(distinct: int) -> int:
    """Words that are clustered first: their bigrams are a matrix on the driver, so they grow with the cube root of the vocabulary."""
    return min(distinct, HEAD, max(1000, round(6 * distinct ** (1 / 3))))


def count_tokens(docs: DataFrame) -> DataFrame:
    """token (a hash), c: of all texts; summed up in each task before the shuffle."""

    def count(batches):
        held: Counter = Counter()

        def out():
            words = list(held)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.record_batch([pa.array(list(map(_key, part)), pa.int64()), pa.array(list(map(held.__getitem__, part)), pa.int64())], ["token", "c"])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for text in utf8(batch.column(0).slice(at, SLICE)):
                    held.update(tokens(text))
                    if len(held) > KEPT_WORDS:
                        yield from out()
        yield from out()

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "token long, c long")
    return rows.groupBy("token").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and counts of the `most` most frequent tokens, ties by the token. The driver sees little more than these: the last band of counts is cut by count, and equal counts by the token's first bits."""
    picked, left, part = F.lit(False), most, F.lit(True)
    for by in (-F.floor(4 * F.log2("c")), -F.col("c"), F.shiftright("token", 48)):
        sizes = counts.where(part).groupBy(by.cast("long").alias("by")).agg(F.count("*").alias("n")).orderBy("by")
        cut = None
        for r in sizes.toLocalIterator():
            if r["n"] > left:
                cut = r["by"]
                break
            left -= r["n"]
        if cut is None:
            picked, part = picked | part, F.lit(False)
            break
        picked, part = picked | (part & (by < cut)), part & (by == cut)
    rows = counts.where(picked | part).toArrow() if most > 0 else None
    token, c = (rows["token"].to_numpy(), rows["c"].to_numpy()) if rows is not None else (np.zeros(0, np.int64),) * 2
    order = np.lexsort((token, -c))[:most]
    return token[order], c[order]


def _gain(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, fixed: int = 0, classes: int = CLASSES) -> np.ndarray:
    """A class for each of the words of a matrix of pairs' counts, the most frequent first; the last `fixed` rows have classes of their own, after those.

    Words start in turn in the classes; each then moves where the mutual information of adjoining classes, the sum of n log n over class
    pairs less that over class margins, is highest, until no word moves.
    """
    n = len(pairs) - fixed
    classes = max(1, min(classes, n))
    of = np.concatenate([np.arange(n) % classes, np.arange(classes, classes + fixed)])
    f = _gain
    left, right = pairs.sum(axis=1).astype(float), pairs.sum(axis=0).astype(float)
    member = np.zeros((len(pairs), classes + fixed))
    member[np.arange(len(pairs)), of] = 1
    after, before = pairs @ member, pairs.T @ member  # word to class, class to word
    joint = member.T @ after
    size_l, size_r = member.T @ left, member.T @ right
    moved = True
    while moved:
        moved = False
        for w in range(n):
            own, a, b, loop = of[w], after[w].copy(), before[w].copy(), pairs[w, w]
            a[own] -= loop
            b[own] -= loop
            # Without w:
            joint[own] -= a
            joint[:, own] -= b
            joint[own, own] -= loop
            size_l[own] -= left[w]
            size_r[own] -= right[w]
            # What each class would gain: its row and column, and the cell where they cross.
            now = f(joint)
            rows = (f(joint + a[None, :]) - now).sum(axis=1)
            columns = (f(joint + b[:, None]) - now).sum(axis=0)
            cross = np.diag(joint)
            both = f(np.maximum(cross + a + b + loop, 0)) - f(cross + a) - f(cross + b) + f(cross)
            margins = f(size_l + left[w]) - f(size_l) + f(size_r + right[w]) - f(size_r)
            gains = (rows + columns + both - margins)[:classes]
            best = int(np.argmax(gains))
            # A gain that rounding could have made is none, so that no word moves to and fro.
            if best != own and gains[best] > gains[own] + 1e-9 * (1 + abs(gains[own])):
                moved = True
                of[w] = best
                after[:, own] -= pairs[:, w]
                after[:, best] += pairs[:, w]
                before[:, own] -= pairs[w]
                before[:, best] += pairs[w]
                a, b = after[w].copy(), before[w].copy()
                a[best] -= loop
                b[best] -= loop
            best = of[w]
            joint[best] += a
            joint[:, best] += b
            joint[best, best] += loop
            size_l[best] += left[w]
            size_r[best] += right[w]
    return of


def best_classes(word: np.ndarray, before: np.ndarray, after: np.ndarray, n: np.ndarray, joint: np.ndarray, classes: int) -> np.ndarray:
    """For words 0, 1, ..., the class where the gain is highest. word, before, after, n: how often a word stands between two classes; after may be len(joint), for none. joint: the core's counts."""
    words, k = int(word.max()) + 1 if len(word) else 0, len(joint)
    b, a = np.zeros((words, k)), np.zeros((words, k + 1))
    np.add.at(b, (word, before), n)
    np.add.at(a, (word, after), n)
    f, a = _gain, a[:, :k]
    gain = np.zeros((words, classes))
    for side, table in ((a, joint[:classes]), (b, joint[:, :classes].T)):
        own, unit = np.nonzero(side)
        for at in range(0, len(own), 50_000):
            i, u = own[at : at + 50_000], unit[at : at + 50_000]
            cells = table[:, u].T
            np.add.at(gain, i, f(cells + side[i, u][:, None]) - f(cells))
    cross = np.diag(joint)[None, :classes]
    x, y = a[:, :classes], b[:, :classes]
    gain += f(cross + x + y) - f(cross + x) - f(cross + y) + f(cross)
    for side, size in ((a, joint.sum(axis=1)), (b, joint.sum(axis=0))):
        gain -= f(size[None, :classes] + side.sum(axis=1)[:, None]) - f(size)[None, :classes]
    return gain.argmax(axis=1)


class Cells:
    """Counts of numbers, as arrays that are summed up now and then."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.keys.append(keys)
        self.counts.append(np.ones(len(keys), np.int64) if counts is None else counts)
        self.size += len(keys)
        if self.size > 2_000_000:
            self.add_up()
            self.size = 0

    def add_up(self) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([*self.keys, np.zeros(0, np.int64)]).astype(np.int64), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([*self.counts, np.zeros(0, np.int64)]), len(keys)).astype(np.int64)
        self.keys, self.counts = [keys], [counts]
        return keys, counts


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' codes, one after the other (-1: none), and their lengths."""
    parts = [np.frombuffer(x.as_buffer(), "<u2") for x in column]
    codes = np.concatenate([*parts, np.zeros(0, np.uint16)]).astype(np.int32)
    codes[codes == NONE] = -1
    return codes, np.array([len(x) for x in parts], np.int64)


def _previous(units: np.ndarray, n: np.ndarray, start: int) -> np.ndarray:
    """Each unit's neighbour before it; `start` at the start of a text."""
    out = np.concatenate([[start], units[:-1]]).astype(np.int64)[: len(units)]
    out[(np.cumsum(n) - n)[n > 0]] = start
    return out


CODED = "row long, doc_id long, held_out boolean, learn boolean, n_tokens long, codes binary, tails array<long>"


def coded(docs: DataFrame, learn: F.Column, held_out: F.Column, head: np.ndarray) -> DataFrame:
    """The texts' tokens as places in the head (two bytes each), and the other tokens' hashes in order."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def code(batches):
        places = dict(zip(shared.value.tolist(), range(len(shared.value))))
        own: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                if len(own) > KEPT_WORDS:
                    own.clear()
                texts = [tokens(x) for x in utf8(part.column(4))]
                words = [w for ws in texts for w in ws]
                found = list(map(own.get, words))
                if None in found:
                    for w in {w for w, v in zip(words, found) if v is None}:
                        key = _key(w)
                        own[w] = places.get(key, key)
                    found = list(map(own.__getitem__, words))
                found = np.array(found, np.int64)
                n = np.array([len(ws) for ws in texts], np.int64)
                ends = np.cumsum(n)
                codes = np.where(found < 0, NONE, found).astype("<u2").tobytes()
                tails = np.concatenate([[0], np.cumsum(found < 0)])[np.concatenate([[0], ends])].astype(np.int32)
                yield pa.record_batch(
                    [*(part.column(i) for i in range(4)), pa.array(n), pa.array([codes[2 * (e - k) : 2 * e] for e, k in zip(ends.tolist(), n.tolist())], pa.binary()), pa.ListArray.from_arrays(pa.array(tails), pa.array(found[found < 0]))],
                    [x.split()[0] for x in CODED.split(", ")],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(code, CODED)


def core_pairs(training: DataFrame, n: int) -> np.ndarray:
    """Counts of adjoining units: the core's words, all others (n), and the start (n + 1)."""

    def pairs(batches):
        cells = Cells()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                codes, lengths = _codes(batch.column(0).slice(at, SLICE))
                units = np.where((codes >= 0) & (codes < n), codes, n).astype(np.int64)
                cells.add(_previous(units, lengths, n + 1) * (n + 2) + units)
        keys, counts = cells.add_up()
        yield pa.record_batch([pa.array(keys), pa.array(counts)], ["cell", "n"])

    out = np.zeros((n + 2) ** 2, np.float32 if n > 4000 else np.float64)
    rows = training.select("codes").mapInArrow(pairs, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(n + 2, n + 2)


def neighbours(training: DataFrame, core: np.ndarray, k: int) -> DataFrame:
    """code (of a word of the head outside the core, else -1), token (of a word outside the head, else 0), seen (cell, n): how often words outside the core stand between two classes.

    core: the core's classes; k: others; k + 1: the start; k + 2: nothing, after the end. A cell is before * (k + 3) + after.
    """
    width = k + 3

    def cells_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        codes, lengths = _codes(part.column(0))
        inside = (codes >= 0) & (codes < len(core))
        units = np.where(inside, core[np.where(inside, codes, 0)] if len(core) else k, k).astype(np.int64)
        after = np.append(units[1:], k + 2)[: len(units)]
        after[np.cumsum(lengths)[lengths > 0] - 1] = k + 2
        return codes, _previous(units, lengths, k + 1) * width + after

    def in_head(batches):
        found = Cells()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                codes, cells = cells_of(batch.slice(at, SLICE))
                own = codes >= len(core)
                found.add(codes[own].astype(np.int64) * width**2 + cells[own])
        keys, counts = found.add_up()
        for at in range(0, len(keys), 100_000):
            own, n = keys[at : at + 100_000], counts[at : at + 100_000]
            yield pa.record_batch([pa.array((own // width**2).astype(np.int32)), pa.array((own % width**2).astype(np.int32)), pa.array(n)], ["code", "cell", "n"])

    def beyond(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                codes, cells = cells_of(part)
                yield pa.record_batch([part.column(1).flatten(), pa.array(cells[codes < 0].astype(np.int32))], ["token", "cell"])

    # Summed up in the tasks already, so they are dealt once, by word; a word has few rows from each task.
    often = training.select("codes").mapInArrow(in_head, "code int, cell int, n long").repartition("code").groupBy("code", "cell").agg(F.sum("n").alias("n"))
    often = often.groupBy("code").agg(F.sum("n").alias("c"), F.collect_list(F.struct("cell", "n")).alias("seen"))
    # A word beyond the head is rare enough to list its places one by one.
    rare = training.select("codes", "tails").mapInArrow(beyond, "token long, cell int").groupBy("token").agg(F.count("*").alias("c"), F.collect_list(F.struct("cell", F.lit(1).cast("long").alias("n"))).alias("seen"))
    columns = lambda code, token: (code.alias("code"), token.alias("token"), "c", "seen")
    return often.select(*columns(F.col("code"), F.lit(0).cast("long"))).unionByName(rare.select(*columns(F.lit(-1), F.col("token"))))


def classed(words: DataFrame, joint: np.ndarray, k: int, least: int) -> DataFrame:
    """code, token, c, class of what `neighbours` gives; k is the class of rare words."""
    shared = words.sparkSession.sparkContext.broadcast(joint)

    def choose(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                often = np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False) >= least)
                out = np.full(part.num_rows, k, np.int32)
                if len(often):
                    seen = part.column(3).take(pa.array(often))
                    word = np.repeat(np.arange(len(often)), seen.value_lengths().to_numpy(zero_copy_only=False))
                    cell, n = (seen.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2))
                    out[often] = best_classes(word, cell // (k + 3), cell % (k + 3), n, shared.value, k)
                yield pa.record_batch([part.column(0), part.column(1), part.column(2), pa.array(out)], ["code", "token", "c", "class"])

    return words.mapInArrow(choose, "code int, token long, c long, class int")


class ClassModel:
    """What the tasks score with: of each token of the head its count and class, of each class its mass and transitions."""

    def __init__(self, counts: np.ndarray, classes: np.ndarray, size: np.ndarray, kinds: np.ndarray, total: int, distinct: int):
        #: k classes by exchange, that of rare words, and the start.
        self.counts, self.classes, self.total, self.distinct = counts, classes, total, distinct
        self.size, self.mass = size, size + 0.5 * (kinds + 1)
        self.rare, self.start = len(size) - 2, len(size) - 1
        self.base_mass = total + 0.5 * (distinct + 1)
        self.move = np.zeros((len(size), len(size)))

    def emit(self, c: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / self.mass[classes])

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / self.base_mass)

    def learn(self, moves: np.ndarray) -> None:
        """moves: counts of adjoining classes, over all training texts."""
        prior = (self.size + 0.5) / (self.size + 0.5).sum()
        self.move = np.log10((moves + SMOOTH * prior) / (moves.sum(axis=1, keepdims=True) + SMOOTH))


FILLED = "doc_id long, held_out boolean, learn boolean, n_tokens long, n_known long, base double, emitted double, classes binary"


def filled(texts: DataFrame, words: DataFrame, model: ClassModel) -> DataFrame:
    """The texts' classes (two bytes each), with the sums that don't depend on transitions."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    tails = texts.select("row", F.posexplode("tails").alias("i", "token")).join(words.select("token", "c", "class"), "token", "left")
    tails = tails.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("class", F.lit(model.rare)).alias("class")))).alias("tails"))

    def fill(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                codes, n = _codes(part.column(4))
                late = part.column(5).flatten()
                c, classes = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
                head = codes >= 0
                c[head], classes[head] = model.counts[codes[head]], model.classes[codes[head]]
                c[~head], classes[~head] = late.field(1).to_numpy(zero_copy_only=False), late.field(2).to_numpy(zero_copy_only=False)
                own = np.repeat(np.arange(len(n)), n)
                sums = lambda x: np.bincount(own, x, len(n))
                data, ends = classes.astype("<i2").tobytes(), np.cumsum(n)
                yield pa.record_batch(
                    [*(part.column(i) for i in range(4)), pa.array(sums(c > 0).astype(np.int64)), pa.array(sums(model.base(c))), pa.array(sums(model.emit(c, classes))), pa.array([data[2 * (e - k) : 2 * e] for e, k in zip(ends.tolist(), n.tolist())], pa.binary())],
                    [x.split()[0] for x in FILLED.split(", ")],
                )

    rows = texts.drop("tails").join(tails, "row", "left").select("doc_id", "held_out", "learn", "n_tokens", "codes", "tails")
    return rows.mapInArrow(fill, FILLED)


def _classes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x.as_buffer(), "<i2") for x in column]
    return np.concatenate([*parts, np.zeros(0, np.int16)]).astype(np.int64), np.array([len(x) for x in parts], np.int64)


def transitions(training: DataFrame, width: int, start: int) -> np.ndarray:
    """Counts of adjoining classes."""

    def pairs(batches):
        seen = np.zeros(width * width, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                classes, n = _classes(batch.column(0).slice(at, SLICE))
                seen += np.bincount(_previous(classes, n, start) * width + classes, minlength=width * width)
        cells = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(cells), pa.array(seen[cells])], ["cell", "n"])

    out = np.zeros(width * width)
    rows = training.select("classes").mapInArrow(pairs, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(width, width)


def score(docs: DataFrame, learn: F.Column, held_out: F.Column, most: int = HEAD, classes: int = CLASSES, least: int = LEAST, core: int | None = None) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity. learn: which rows may be learned from."""
    counts = checkpointed(count_tokens(docs.where(learn)), 1_000_000)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n = min(core or core_size(distinct), distinct)
    head, head_counts = head_of(counts, min(max(most, n), HEAD))
    texts = checkpointed(coded(docs, learn, held_out, head), 5_000)
    training = texts.where("learn")
    if not total:
        return texts.select("doc_id", "held_out", "n_tokens", F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"), F.lit(1.0).alias("perplexity"))

    # Classes: of the core, then of all other words.
    pairs = core_pairs(training, n)
    of = exchange(pairs, 2, classes)
    k = int(of[-2])  # the class of other words, after those of the exchange
    member = np.zeros((n + 2, k + 2))
    member[np.arange(n + 2), of] = 1
    words = checkpointed(classed(neighbours(training, of[:n].astype(np.int64), k), member.T @ pairs @ member, k, least), 1_000_000)
    own = np.full(len(head), k, np.int64)
    own[:n] = of[:n]
    late = words.where("code >= 0").select("code", "class").toArrow()  # no more rows than the head has
    own[late["code"].to_numpy()] = late["class"].to_numpy()
    words = words.where("code < 0")
    size, kinds = np.bincount(own, head_counts, k + 2), np.bincount(own, minlength=k + 2).astype(float)
    for r in words.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        size[r["class"]] += r["c"]
        kinds[r["class"]] += r["n"]
    model = ClassModel(head_counts, own, size, kinds, total, distinct)

    # Transitions, then scores.
    rows = checkpointed(filled(texts, words, model), 5_000)
    model.learn(transitions(rows.where("learn"), k + 2, model.start))
    move, start = model.move, model.start

    def finish(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                seen, lengths = _classes(part.column(5))
                moved = np.bincount(np.repeat(np.arange(len(lengths)), lengths), move[_previous(seen, lengths, start), seen], len(lengths))
                yield pa.record_batch([*(part.column(i) for i in range(5)), pa.array(moved + part.column(6).to_numpy())], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = rows.select("doc_id", "held_out", "n_tokens", "n_known", "base", "classes", "emitted").mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), F.least(-F.col("score") / F.col("n_tokens"), F.lit(300.0))).alias("perplexity"),
    )


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents"), remainder("doc_id", 5)
    return score(docs, part != 1, part == 1)
