"""Licence scan: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates and/or/with expressions.

A text's words are runs of a-z (A-Z lower-cased), 0-9 and non-ASCII bytes. One automaton holds every phrase, as words with a
blank on either side, so a hit is a place where the phrase's words stand consecutively. An identifier tag's expression, read from
the text as it is, is parsed by precedence (with, and, or; parentheses) and evaluated for the licences that it names
and for whether it can be met by permissive ones alone: `or` needs one side, `and` both; `with` keeps its left side's answer if its right side is a known exception that grants more, and
is not permissive if that restricts (it then has a label too) or is unknown. Identifiers are matched whole, a name with a version and perhaps +, -only or -or-later; one that isn't known is a label of its own and not permissive.
Notice phrases that stand within `NEAR` words, joined by or/and, are evaluated as one expression too.

Labels: the family of each phrase found (base ones among them) and of each identifier in a tag's expression. Score: evidence that the text carries
licence terms, 1 - product of (1 - weight) over the findings; a tag weighs more than a phrase.

Defined results: a null text is the empty text, with no words, no labels (empty strings), null places and score 0. A tag with
a malformed expression counts as a finding, with the identifiers read so far as labels and permissive null. A very long text is scanned whole. Repeated rows
get a row each; other columns aren't read.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table, utf8

#: The phrases and labels that every scan reports.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Phrases of this method, notices of further licences and more exact forms of the base ones.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu gpl": "gpl",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common public license": "cpl",
    "common development and distribution license": "cddl",
    "microsoft public license": "ms-pl",
    "server side public license": "sspl",
    "business source license": "busl",
    "elastic license": "elastic",
    "open software license": "osl",
    "academic free license": "afl",
    "artistic license": "artistic",
    "apache software license": "apache",
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "postgresql license": "postgresql",
    "python software foundation license": "python",
    "universal permissive license": "upl",
    "blue oak model license": "blueoak",
    "boost software license": "bsl",
    "sil open font license": "ofl",
    "open database license": "odbl",
    "the unlicense": "unlicense",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by nd": "cc-by-nd",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc0 1 0 universal": "cc0",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "commons clause": "commons-clause",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: By family, names of identifiers and their versions ("-": none). A family's own name is one of its identifiers.
PERMISSIVE_NAMES = {
    "mit": "MIT - 0 CMU Modern-Variant advertising feh Wu open-group|MITNFA -|X11 -",
    "apache": "Apache 1.0 1.1 2.0",
    "bsd": "0BSD -|BSD 1-Clause 2-Clause 2-Clause-Patent 2-Clause-Views 3-Clause 3-Clause-Clear 3-Clause-LBNL 4-Clause Source-Code",
    "isc": "ISC - Veillard",
    "bsl": "BSL 1.0",
    "zlib": "Zlib - acknowledgement",
    "unlicense": "Unlicense -",
    "cc0": "CC0 1.0",
    "cc-by": "CC-BY 1.0 2.0 2.5 3.0 4.0",
    "afl": "AFL 1.1 1.2 2.0 2.1 3.0",
    "artistic": "Artistic 1.0 2.0",
    "python": "PSF 2.0|Python 2.0 2.0.1",
    "postgresql": "PostgreSQL -",
    "ncsa": "NCSA -",
    "upl": "UPL 1.0",
    "blueoak": "BlueOak 1.0.0",
    "wtfpl": "WTFPL -",
    "ms-pl": "MS-PL -",
    "ecl": "ECL 1.0 2.0",
    "zpl": "ZPL 1.1 2.0 2.1",
    "php": "PHP 3.0 3.01",
}
OTHER_NAMES = {
    "gpl": "GPL 1.0 2.0 3.0",
    "lgpl": "LGPL 2.0 2.1 3.0",
    "agpl": "AGPL 1.0 3.0",
    "mpl": "MPL 1.0 1.1 2.0",
    "epl": "EPL 1.0 2.0",
    "eupl": "EUPL 1.0 1.1 1.2",
    "cpl": "CPL 1.0",
    "cddl": "CDDL 1.0 1.1",
    "osl": "OSL 1.0 2.0 2.1 3.0",
    "ofl": "OFL 1.0 1.1",
    "odbl": "ODbL 1.0",
    "ms-rl": "MS-RL -",
    "cc-by-sa": "CC-BY-SA 1.0 2.0 2.5 3.0 4.0",
    "cc-by-nc": "CC-BY-NC 1.0 2.0 2.5 3.0 4.0|CC-BY-NC-SA 1.0 2.0 2.5 3.0 4.0|CC-BY-NC-ND 1.0 2.0 2.5 3.0 4.0",
    "cc-by-nd": "CC-BY-ND 1.0 2.0 2.5 3.0 4.0",
    "busl": "BUSL 1.1",
    "sspl": "SSPL 1.0",
    "elastic": "Elastic 2.0",
    "proprietary": "LicenseRef Proprietary",
}
#: Exceptions that grant more than the licence before them, and additions that grant less.
LOOSER = "classpath-exception-2.0 llvm-exception gcc-exception-2.0 gcc-exception-3.1 autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception font-exception-2.0 libtool-exception linux-syscall-note openjdk-assembly-exception-1.0 qt-gpl-exception-1.0 swift-exception u-boot-exception-2.0 wxwindows-exception-3.1".split()
STRICTER = "commons-clause".split()


def _identifiers() -> dict[str, tuple[str, bool]]:
    """Lower-case identifiers with their families and whether these are permissive."""
    out = {}
    for names, permissive in ((OTHER_NAMES, False), (PERMISSIVE_NAMES, True)):
        for family, text in names.items():
            out[family] = family, permissive
            for part in text.split("|"):
                name, *versions = part.lower().split()
                out |= {name if v == "-" else f"{name}-{v}": (family, permissive) for v in versions}
    return out


IDENTIFIERS = _identifiers()
TAG_WEIGHT, PHRASE_WEIGHT = 0.95, 0.8
NEAR = 6

LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
#: A-Z to a-z, what no word holds to a blank.
WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in LOWER)
RANK = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")


def licence(identifier: str) -> tuple[str, bool]:
    """The family of an identifier, and whether it is permissive."""
    low = identifier.lower().removesuffix("+").removesuffix("-only").removesuffix("-or-later")
    return IDENTIFIERS.get(low, (identifier.lower(), False))


def parse(expression: str) -> list[str] | None:
    """The expression in postfix order; None if it is malformed."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # what may come next
    for token in TOKEN.findall(expression):
        low = token.lower()
        if low in RANK:
            if operand:
                return None
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        elif token == "(":
            if not operand:
                return None
            held.append(token)
        elif token == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """The families that the expression names, and whether permissive licences alone can meet it."""
    stack: list[tuple[set[str], bool, str]] = []
    for token in postfix:
        if token == "with":
            (_, _, addition), (a, met, _) = stack.pop(), stack.pop()
            looser = addition.lower() in LOOSER
            stack.append((a if looser else a | {addition.lower()}, met and looser, ""))
        elif token in RANK:
            (b, met_b, _), (a, met_a, _) = stack.pop(), stack.pop()
            stack.append((a | b, met_a or met_b if token == "or" else met_a and met_b, ""))
        else:
            family, permissive = licence(token)
            stack.append(({family}, permissive, token))
    return stack[-1][:2]


def tag_expression(line: str) -> str:
    """The longest part at the start of a line, after its tag, that reads as an expression: operands stand between operators or parentheses."""
    kept, depth, operand = [], 0, True
    for token in TOKEN.findall(line):
        low = token.lower()
        if low in RANK:
            if operand:
                break
            operand = True
        elif token == "(":
            if not operand:
                break
            depth += 1
        elif token == ")":
            if operand or not depth:
                break
            depth -= 1
        else:
            if not operand:
                break
            operand = False
            token = token.rstrip(".:") or token
        kept.append(token)
    while kept and kept[-1].lower() in RANK:
        kept.pop()
    return " ".join(kept)


def automaton():
    out = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        out.add_word(f" {phrase} ", (phrase, len(phrase.split())))
    out.make_automaton()
    return out


def scan(text: bytes, find) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, score, permissive."""
    words = text.translate(WORDS).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    hits = [(end - len(phrase) - 1, phrase, n) for end, (phrase, n) in find.iter(line)]
    if not hits:
        return len(words), 0, None, None, "", "", 0.0, None
    hits.sort()
    places, at, seen = [], 0, 0  # (first word, words, phrase)
    for start, phrase, n in hits:
        seen += line.count(" ", at, start)
        at = start
        places.append((seen, n, phrase))
    base = [(w, p) for w, _, p in places if p in BASE]
    labels, left, permissive = {BASE[p] for _, p in base}, 1.0, []
    # A notice inside a longer one is part of it to the expressions and the score; its places still count as base.
    named, end = [], 0
    for w, n, p in sorted((x for x in places if x[2] != TAG), key=lambda x: (x[0], -x[1])):
        if w + n > end:
            named.append((w, n, BASE.get(p) or NOTICES[p]))
            end = w + n
    for w, n, label in named:
        labels.add(label)
        left *= 1 - PHRASE_WEIGHT
    # Notices that and/or join within a few words are one expression.
    run: list[str] = []
    for (w, n, label), after in zip(named, [*named[1:], None]):
        run.append(label)
        between = [x.decode("latin-1") for x in words[w + n : after[0]]] if after and after[0] - w - n <= NEAR else []
        joint = next((x for x in between if x in ("or", "and")), None)
        if joint:
            run.append(joint)
        else:
            postfix = parse(" ".join(run))
            if postfix:
                permissive.append(evaluate(postfix)[1])
            run = []
    if any(p == TAG for _, _, p in places):
        for m in re.finditer(r"(?i)SPDX[^A-Za-z0-9\n]*License[^A-Za-z0-9\n]*Identifier[^A-Za-z0-9(\n]*([^\n]*)", text.decode("utf-8", "replace")):
            left *= 1 - TAG_WEIGHT
            expression = tag_expression(m[1])
            postfix = parse(expression)
            if postfix:
                names, met = evaluate(postfix)
                labels |= names
                permissive.append(met)
            else:
                labels |= {licence(x)[0] for x in TOKEN.findall(expression) if x.lower() not in RANK and x not in "()"}
    starts = [w for w, _ in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({BASE[p] for _, p in base})), ",".join(sorted(labels)), 1 - left, all(permissive) if permissive else None,
    )


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document, as SCHEMA says; permissive: whether all that was found can be met by permissive licences alone."""
    found: list = []

    def scans(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not found:
            found.append(automaton())
        rows = [scan(x, found[0]) for x in utf8(batch.column(1))]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.record_batch([batch.column(0), *columns], [x.split()[0] for x in SCHEMA.split(", ")])

    return map_slices(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), scans, SCHEMA)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
