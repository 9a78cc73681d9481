import re

from tidejoin.llm import licenses as L


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in L.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


TEXTS = [
    None, "", "...", "MIT License", "the mit-license, the MIT\nLicense mit license", "Licensed under the GNU General Public License, version 3.",
    "mit licenses xmit license", "é MIT License ñ", "Apache License or MIT License. GNU Affero General Public License!", "x" * 50000 + " apache license",
    "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\nrest", "SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0", "SPDX-License-Identifier: AND MIT",
]


def test_base_places_against_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, None, "clash")]
    got = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:6] == brute(TEXTS[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_expressions():
    find = L.automaton()
    label = lambda t: L.scan(t.encode(), find)[5:8:2]
    assert label(TEXTS[10]) == ("bsd,gpl,mit", True)
    assert label(TEXTS[11]) == ("gpl", False)
    assert label(TEXTS[12]) == ("", None)
    tag = lambda t: label(f"SPDX-License-Identifier: {t}")
    assert tag("MIT WITH Commons-Clause") == ("commons-clause,mit", False) and tag("MIT WITH no-such-exception") == ("mit,no-such-exception", False)
    assert tag("Apache-2.0 WITH LLVM-exception") == ("apache", True) and tag("GPL-2.0-or-later OR MIT") == ("gpl,mit", True)
    assert tag("MITRE-Research") == ("mitre-research", False) and tag("BSD-Protection") == ("bsd-protection", False) and tag("LGPL-2.1+") == ("lgpl", False)
    assert label(TEXTS[8]) == ("agpl,apache,gpl,mit", False)
    assert L.evaluate(L.parse("MIT AND GPL-2.0 OR Apache-2.0")) == ({"mit", "gpl", "apache"}, True)
    assert L.parse("(MIT") is None and L.parse("MIT)") is None and L.parse("MIT GPL") is None and L.parse("") is None


def answer(text):
    """By recursive descent: families, and whether permissive ones alone can meet it."""
    words = re.findall(r"[()]|[^\s()]+", text)

    def choice():
        names, met = both()
        while words and words[0] == "OR":
            words.pop(0)
            more, other = both()
            names, met = names | more, met or other
        return names, met

    def both():
        names, met = one()
        while words and words[0] == "AND":
            words.pop(0)
            more, other = one()
            names, met = names | more, met and other
        return names, met

    def one():
        word = words.pop(0)
        if word == "(":
            names, met = choice()
            words.pop(0)
        else:
            names, met = {L.licence(word)[0]}, L.licence(word)[1]
        while words and words[0] == "WITH":
            words.pop(0)
            addition = words.pop(0).lower()
            names, met = (names, met) if addition in L.LOOSER else (names | {addition}, False)
        return names, met

    return choice()


def test_expressions_against_recursive_descent():
    import random

    rng = random.Random(6)

    def some(depth):
        if depth == 0 or rng.random() < 0.3:
            word = rng.choice(["MIT", "GPL-2.0-only", "Apache-2.0", "BSD-3-Clause", "X-1", "CC-BY-NC-4.0", "LGPL-2.1+"])
            return word + rng.choice(["", "", " WITH LLVM-exception", " WITH Commons-Clause"])
        inner = f"{some(depth - 1)} {rng.choice(['AND', 'OR'])} {some(depth - 1)}"
        return f"({inner})" if rng.random() < 0.5 else inner

    for _ in range(300):
        text = some(4)
        assert L.evaluate(L.parse(text)) == answer(text) and L.tag_expression(text) == " ".join(L.TOKEN.findall(text))


def test_labels_of_phrases_against_brute_force():
    import random

    rng, find = random.Random(7), L.automaton()
    phrases = {**L.BASE, **L.NOTICES}
    for _ in range(200):
        parts = [rng.choice([*phrases, "some words", "general public", "a license"]) for _ in range(8)]
        text = " zzz ".join(parts) if rng.random() < 0.5 else " ".join(parts)
        line = f" {' '.join(re.findall(r'[a-z0-9]+', text))} "
        assert L.scan(text.encode(), find)[5] == ",".join(sorted({label for p, label in phrases.items() if f" {p} " in line}))


def test_empty_table(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_notice_inside_a_longer_one_is_part_of_it():
    find = L.automaton()
    scan = lambda t: L.scan(t.encode(), find)
    for text, permissive in (
        ("apache license or gnu general public license", True), ("mit license or general public license", True),
        ("gnu general public license or apache license", True), ("apache license and gnu general public license", False),
        ("gnu general public license", False), ("mit license", True),
    ):
        got = scan(text)
        assert got[7] is permissive, text
        assert got[1:5] == brute(text)[1:5]
        # As much evidence as there are notices, however they are worded.
        assert abs(got[6] - (1 - (1 - L.PHRASE_WEIGHT) ** text.count("license"))) < 1e-9
