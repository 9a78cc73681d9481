"""SentencePiece encoding with seeded merge-dropout, and decoding.

A BPE vocabulary (a public model file, whose path is a parameter) is used as it is. A text, with one blank before it, is cut at the starts of blanks' runs and
at newlines, over which no piece reaches. Within such a token, an agenda holds the pairs of adjoining pieces that make a piece, best score first, leftmost
first among equals. Each candidate taken from the agenda is skipped if a hash of (seed, doc_id, the token and its place in the document, the places in the token of both pieces) is below `dropout`; a skipped pair
returns only inside other merges. So segmentations vary by merges, and every one decodes to the text. With dropout 0 the result is the model's own.

So each occurrence of a token has draws of its own. Tasks keep only what has no draws: a token's characters, its pieces at dropout 0 and the candidates that
these merge. An occurrence that skips none of them has these pieces; all others are segmented. Reruns agree, whatever the partitions.

Streams are an option: with `streams` above 0, occurrence i draws from stream (i + a hash of seed and doc_id) modulo `streams` instead, so a token has up to that many segmentations.

Characters that no piece covers are encoded as bytes. Vocabularies' blank marks are read as blanks, so a mark in a text is a character like any other, and is
encoded as bytes: decoding gives back any text.

Defined results: a null text has null ids and 0 pieces, an empty text has no pieces, and both count as lossless; a null doc_id draws as the empty
text; repeated rows get a row each, and the same ids; a very long text is encoded alone, in whole; other columns aren't read.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table

DROPOUT = 0.1
SEED = 20_240_607
#: 0: each occurrence of a token has its own draws.
STREAMS = 0
#: Tokens, and their characters, that a Python worker keeps; beyond either it starts anew.
KEPT, KEPT_CHARACTERS = 500_000, 8_000_000
#: Characters of texts that are encoded together; a longer text is encoded alone.
TOGETHER = 1_000_000
TOKEN = re.compile(r" *[^ \n]+| +|\n")
MASK = 2**64 - 1


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces (with blanks for blank marks), ranks (the less, the better a merge), and ids."""

    def __init__(self, model: str):
        import sentencepiece

        pack = lambda i: int(i).to_bytes(4, "little")
        m = sentencepiece.SentencePieceProcessor(model_file=model)
        self.packed, self.ranks, self.bytes, self.table = {}, {}, [b""] * 256, []  # ids are packed to four bytes
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = pack(i)
                self.table.append(bytes([value]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.table.append(b"")
            else:
                piece = piece.replace("▁", " ")
                self.packed[piece] = pack(i)
                self.ranks[piece] = -m.get_score(i)
                self.table.append(piece.encode())
        splits = [(piece[:i], piece[i:], piece) for piece in self.packed for i in range(1, len(piece))]
        number = lambda piece: int.from_bytes(self.packed[piece], "little")
        self.pairs = np.array([tuple(map(number, x)) for x in splits if x[0] in self.packed and x[1] in self.packed], np.int32).reshape(-1, 3)
        self.mark = xxhash.xxh3_128_hexdigest(repr((self.table, sorted(self.ranks.items()))))

    def arrays(self) -> tuple[Pairs, np.ndarray, np.ndarray]:
        """For array work: the pairs; by id, the place of the piece's score among all, then NONE; by code point, the character's id or -1."""
        places = {r: i for i, r in enumerate(sorted(set(self.ranks.values())))}
        ranks, characters = np.full(len(self.table) + 1, NONE, np.int32), np.full(0x110000, -1, np.int32)
        for piece, packed in self.packed.items():
            i = int.from_bytes(packed, "little")
            ranks[i] = places[self.ranks[piece]]
            if len(piece) == 1:
                characters[ord(piece)] = i
        return Pairs(*self.pairs.T), ranks, characters

    def decode(self, ids: np.ndarray) -> str:
        """The text; the blank that encoding puts first is taken off."""
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def place_key(a: int, b: int, c: int) -> int:
    """An odd number for a candidate: the merge of the piece from a to b with that from b to c."""
    h = (a * 0x9E3779B97F4A7C15 + b * 0x9FB21C651E98DF25 + c * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & MASK
    h = (h ^ h >> 32) * 0xFF51AFD7ED558CCD & MASK
    return (h ^ h >> 29) * 0xC4CEB9FE1A85EC53 & MASK | 1


def segment(token: str, ranks: dict[str, float], base: int = 0, limit: int = -1) -> list[str]:
    """The token's pieces; ranks: the lowest is merged first. A candidate is skipped if the low 64 bits of base times its place's key are not above limit."""
    n = len(token)
    end = list(range(1, n + 1))  # of the piece that starts here
    before = list(range(-1, n - 1))  # start of the piece before
    agenda = [(ranks[token[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if token[i : i + 2] in ranks]
    heapify(agenda)
    while agenda:
        _, a, b, c = heappop(agenda)
        if end[a] != b or end[b] != c:
            continue  # one of the two is gone
        if base * place_key(a, b, c) & MASK <= limit:
            continue
        end[a] = c
        end[b] = -1
        if c < n:
            before[c] = a
            piece = token[a : end[c]]
            if piece in ranks:
                heappush(agenda, (ranks[piece], a, c, end[c]))
        p = before[a]
        if p >= 0:
            piece = token[p:c]
            if piece in ranks:
                heappush(agenda, (ranks[piece], p, a, c))
    out, at = [], 0
    while at < n:
        out.append(token[at : end[at]])
        at = end[at]
    return out


#: Tokens of up to so many characters are segmented together, in arrays; longer ones one by one.
SHORT = 32
PLACES = np.array([[[place_key(a, b, c) for c in range(SHORT + 1)] for b in range(SHORT + 1)] for a in range(SHORT + 1)], np.uint64)
NONE = np.iinfo(np.int32).max


class Pairs:
    """The piece that two pieces make, for arrays of ids: a hash table with linear probing."""

    FREE = np.uint64(MASK)

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        bits = max(8, int(4 * len(made)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), 2**bits - 1
        self.keys, self.made = np.full(2**bits, self.FREE), np.full(2**bits, -1, np.int32)
        keys, self.steps = self._keys(left, right), 0
        home, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            at = home[todo] + self.steps & self.last
            free = self.keys[at] == self.FREE
            self.keys[at[free]] = keys[todo[free]]
            placed = self.keys[at] == keys[todo]
            self.made[at[placed]] = made[todo[placed]]
            todo = todo[~placed]
            self.steps += 1

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1 where two pieces make none."""
        keys = self._keys(left, right)
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.made[at], np.int32(-1))
        left_over = np.flatnonzero((found != keys) & (found != self.FREE))
        for step in range(1, self.steps):
            if not len(left_over):
                break
            at_step, wanted = at[left_over] + step & self.last, keys[left_over]
            found = self.keys[at_step]
            hit = found == wanted
            out[left_over[hit]] = self.made[at_step[hit]]
            left_over = left_over[~hit & (found != self.FREE)]
        return out


def segment_all(ids: np.ndarray, pairs: Pairs, ranks: np.ndarray, bases: np.ndarray, limit: int, merges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces of n tokens of equal length, one after the other, and each token's number of pieces; ids: those of their characters.

    Each round takes the best candidate from each token's agenda, a row by start, and merges or skips it, as `segment` does. merges gets each round's (tokens, place keys) of the candidates that are merged.
    """
    n, width = ids.shape
    ids = ids.reshape(-1).astype(np.int32)  # of the piece that starts here; -1: none does
    after = np.arange(1, len(ids) + 1)
    before = np.arange(-1, len(ids) - 1)
    made = np.full(len(ids), -1, np.int32)
    starts = np.arange(n) * width
    before[starts] = -1
    inner = np.arange(len(ids)).reshape(n, width)[:, :-1].reshape(-1)
    made[inner] = pairs.find(ids[inner], ids[inner + 1])
    ranked = ranks[made]  # the last of ranks is NONE
    agenda = ranked.reshape(n, width)
    live = np.arange(n)
    while len(live):
        a = live * width + agenda[live].argmin(axis=1)
        open_ = ranked[a] != NONE
        live, a = live[open_], a[open_]
        b = after[a]
        c = after[b]
        row = live
        if limit >= 0:
            skipped = bases[row] * PLACES[a - starts[row], b - starts[row], c - starts[row]] <= np.uint64(limit)
            ranked[a[skipped]] = NONE
            merged = ~skipped
            row, a, b, c = row[merged], a[merged], b[merged], c[merged]
        if merges is not None:
            merges.append((row, PLACES[a - starts[row], b - starts[row], c - starts[row]]))
        ids[a], after[a], ids[b], ranked[b] = made[a], c, -1, NONE
        inside = c < starts[row] + width
        ranked[a[~inside]] = NONE
        x, y = a[inside], c[inside]
        before[y] = x
        p = before[a]
        behind = p >= 0
        x, y = np.concatenate([x, p[behind]]), np.concatenate([y, a[behind]])
        made[x] = pairs.find(ids[x], ids[y])
        ranked[x] = ranks[made[x]]
    there = ids >= 0
    return ids[there], there.reshape(n, width).sum(axis=1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 of unsigned numbers."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Pool:
    """Spans of one growing array."""

    def __init__(self, kind):
        self.data, self.starts, self.lengths, self.size, self.n = np.zeros(1024, kind), np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0, 0

    def add(self, data: np.ndarray, lengths: np.ndarray) -> None:
        size, n = self.size + len(data), self.n + len(lengths)
        if size > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(size, self.data.dtype)])
        if n > len(self.starts):
            self.starts, self.lengths = np.concatenate([self.starts, np.zeros(n, np.int64)]), np.concatenate([self.lengths, np.zeros(n, np.int64)])
        self.data[self.size : size] = data
        self.starts[self.n : n] = self.size + np.cumsum(lengths) - lengths
        self.lengths[self.n : n] = lengths
        self.size, self.n = size, n


class Encoder:
    """Encodes texts, and keeps of each token what has no draws."""

    def __init__(self, vocabulary: Vocabulary, dropout: float, seed: int, streams: int):
        self.vocabulary, self.seed, self.streams = vocabulary, seed, streams
        self.limit = int(dropout * 2**64) - 1
        self.pairs, self.ranks, self.characters = vocabulary.arrays()
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.tokens: list[str] = []
        #: By token: its hash; whether arrays can segment it; its characters' ids, its pieces at dropout 0 and the keys of their merges.
        self.hashes, self.short, self.signs, self.plain, self.merges = Pool(np.uint64), Pool(bool), Pool(np.int32), Pool(np.int32), Pool(np.uint64)

    def _groups(self, which: np.ndarray):
        """The places in `which` of its tokens that arrays can segment, by length, with their characters' ids."""
        lengths = np.where(self.short.data[which], self.signs.lengths[which], 0)
        for length in np.unique(lengths[lengths > 0]).tolist():
            at = np.flatnonzero(lengths == length)
            yield at, self.signs.data[self.signs.starts[which[at]][:, None] + np.arange(length)]

    def _learn(self, tokens: list[str]) -> None:
        first = len(self.tokens)
        self.numbers.update(zip(tokens, range(first, first + len(tokens))))
        self.tokens += tokens
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        signs = self.characters[np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), "<u4")]
        short = (lengths <= SHORT) & (np.add.reduceat(signs < 0, np.cumsum(lengths) - lengths) == 0)
        one = np.ones(len(tokens), np.int64)
        self.hashes.add(np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"), self.seed & MASK) for t in tokens], np.uint64), one)
        self.short.add(short, one)
        self.signs.add(signs, lengths)
        pieces: list[np.ndarray] = [np.zeros(0, np.int32)] * len(tokens)
        merges: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(tokens)
        for at, ids in self._groups(np.arange(first, first + len(tokens))):
            found: list = []
            made, counts = segment_all(ids, self.pairs, self.ranks, np.zeros(len(at), np.uint64), -1, found)
            rows, keys = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            keys = keys[np.argsort(rows, kind="stable")]
            ends = np.cumsum(np.bincount(rows, minlength=len(at)))
            for i, x, y in zip(at.tolist(), np.split(made, np.cumsum(counts)[:-1]), np.split(keys, ends[:-1])):
                pieces[i], merges[i] = x, y
        if self.limit < 0:
            for i in np.flatnonzero(~short).tolist():
                pieces[i] = self._alone(tokens[i], 0)
        for pool, parts in ((self.plain, pieces), (self.merges, merges)):
            pool.add(np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts)))

    def _alone(self, token: str, base: int) -> np.ndarray:
        """The ids of a token that is long or has characters that no piece covers; those go as bytes."""
        packed, as_bytes = self.vocabulary.packed, self.vocabulary.bytes
        pieces = segment(token, self.vocabulary.ranks, base, self.limit)
        return np.frombuffer(b"".join(packed[p] if p in packed else b"".join(as_bytes[b] for b in p.encode("utf-8", "surrogatepass")) for p in pieces), "<i4")

    def encode(self, texts: list[str], keys: list[str]) -> list[np.ndarray]:
        """The ids of each text, whose draws depend on its key."""
        words = [TOKEN.findall(" " + t) if t else [] for t in texts]
        if len(self.tokens) > KEPT or self.signs.size > KEPT_CHARACTERS:
            self._forget()
        if new := set().union(*words).difference(self.numbers):
            self._learn(list(new))
        of = np.fromiter((i for own in words for i in map(self.numbers.__getitem__, own)), np.int64)
        n = np.fromiter(map(len, words), np.int64, len(words))
        starts, counts = self.plain.starts[of], self.plain.lengths[of]
        source = [self.plain.data[: self.plain.size]]
        if self.limit >= 0:
            documents = np.array([xxhash.xxh3_64_intdigest(k, self.seed & MASK) for k in keys], np.uint64)
            place = _spans(np.zeros(len(n), np.int64), n).astype(np.uint64)
            draws = np.repeat(documents, n)
            if self.streams:
                draws, place = np.uint64(self.seed & MASK), (place + np.repeat(documents % np.uint64(self.streams), n)) % np.uint64(self.streams)
            bases = _mixed(_mixed(draws + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) ^ self.hashes.data[of])
            # Occurrences that skip a candidate of their pieces at dropout 0, and those of which these aren't kept.
            tries = self.merges.lengths[of]
            own = np.repeat(np.arange(len(of)), tries)
            skips = bases[own] * self.merges.data[_spans(self.merges.starts[of], tries)] <= np.uint64(self.limit)
            other = ~self.short.data[of]
            other[own[skips]] = True
            other = np.flatnonzero(other)
            size = self.plain.size
            for at, ids in self._groups(of[other]):
                at = other[at]
                pieces, counts[at] = segment_all(ids, self.pairs, self.ranks, bases[at], self.limit)
                starts[at] = size + np.cumsum(counts[at]) - counts[at]
                source.append(pieces)
                size += len(pieces)
            for i in other[~self.short.data[of[other]]].tolist():
                pieces = self._alone(self.tokens[of[i]], int(bases[i]))
                starts[i], counts[i] = size, len(pieces)
                source.append(pieces)
                size += len(pieces)
        ids = np.concatenate(source)[_spans(starts, counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(n)]
        return np.split(ids, ends[:-1]) if len(n) else []


#: A worker's encoders, which outlast its tasks.
ENCODERS: dict[tuple, Encoder] = {}


def encoder_of(vocabulary: Vocabulary, dropout: float, seed: int, streams: int) -> Encoder:
    key = (vocabulary.mark, dropout, seed, streams)
    if key not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[key] = Encoder(vocabulary, dropout, seed, streams)
    return ENCODERS[key]


SCHEMA = "doc_id long, n_pieces long, lossless boolean, ids array<int>"


def encode_documents(docs: DataFrame, model: str | None = None, dropout: float = DROPOUT, seed: int = SEED, streams: int = STREAMS) -> DataFrame:
    """A row per document, as SCHEMA says; lossless: whether decoding the ids gives the text."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model or default_model()))  # of a size that the file fixes

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder_of(shared.value, dropout, seed, streams)
        texts = batch.column(1).to_pylist()
        keys = ["" if d is None else str(d) for d in batch.column(0).to_pylist()]
        part = np.cumsum([0 if t is None else len(t) for t in texts]) // TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        ids = [x for i, j in zip(cuts, cuts[1:]) for x in own.encode([t or "" for t in texts[i:j]], keys[i:j])]
        right = [own.vocabulary.decode(x) == (t or "") for x, t in zip(ids, texts)]
        n = np.array([len(x) for x in ids], np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), mask=np.array([*(t is None for t in texts), False]))
        arrays = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
        return pa.record_batch([batch.column(0), pa.array(n), pa.array(right), arrays], [x.split()[0] for x in SCHEMA.split(", ")])

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), encode, SCHEMA)


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids are a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model or default_model()))

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if x is None else shared.value.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_slices(encoded.select("doc_id", "ids"), decode, "doc_id long, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
