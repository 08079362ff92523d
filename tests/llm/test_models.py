"""The trained models on wordings and notations that they weren't fitted on: recall and false findings."""

from __future__ import annotations

import os
import random

import pytest

from sparkloom.llm import licences, pii

FOLDER = "/root/testdata/sf0.1"
COMMON = "the of and to in is that it was for on are with his they at be this have from word some what there we can out other were all your when up use how said each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find".split()


# Personal data


def addresses(rng: random.Random) -> dict:
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(mark: str) -> str:
        front = d(15)
        whole = next(front + c for c in "0123456789" if pii.luhn(front + c))
        return mark.join(whole[i : i + 4] for i in range(0, 16, 4))

    return {
        "name [at] host [dot] org": lambda: f"{word()}.{word()} [at] {word()} [dot] org",
        "word [at] word [dot] org": lambda: f"{word()} [at] {word()} [dot] org",
        "userNN (at) exampleN.com": lambda: f"user{d(2)} (at) example{d(1)}.com",
        "name(at)host(dot)net": lambda: f"{word()}(at){word()}(dot)net",
        "name at host dot com": lambda: f"{word()} at {word()} dot com",
        "dotted card": lambda: card("."),
        "card with slashes": lambda: card("/"),
        "(xxx) xxx-xxxx": lambda: f"({d(3)}) {d(3)}-{d(4)}",
        "(xxx)xxx-xxxx": lambda: f"({d(3)}){d(3)}-{d(4)}",
        "xxx-xxx-xxxx": lambda: f"{d(3)}-{d(3)}-{d(4)}",
        "1-xxx-xxx-xxxx": lambda: f"1-{d(3)}-{d(3)}-{d(4)}",
        "xxx.xxx.xxxx": lambda: f"{d(3)}.{d(3)}.{d(4)}",
        "xxx xxx xxxx": lambda: f"{d(3)} {d(3)} {d(4)}",
    }


@pytest.fixture(scope="module")
def weights():
    if not os.path.isdir(FOLDER):
        pytest.skip("no fixture tables")
    import duckdb

    rows = duckdb.sql(f"SELECT text FROM '{FOLDER}/documents.parquet' WHERE regexp_matches(text, '@|[0-9]{{3}}') ORDER BY md5(text) LIMIT {pii.SAMPLE}").fetchall()
    return pii.fit([r[0][:20_000] for r in rows])


@pytest.mark.parametrize("notation", addresses(random.Random(0)))
def test_pii_recall_by_notation(weights, notation):
    rng = random.Random(notation)
    make = addresses(rng)[notation]
    words = lambda: " ".join(rng.choice(COMMON) for _ in range(rng.randrange(2, 9)))
    found = 0
    for _ in range(100):
        entity = make()
        text = f"{words()} {entity}{rng.choice([' ', '. ', ', ', chr(10)])}{words()}"
        found += entity in [text[s["start"] : s["end"]] for s in pii.spans_of(text, weights)]
    assert found >= 90


def test_pii_leaves_numbers_in_prose_alone(weights):
    rng = random.Random(5)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    found = 0
    for _ in range(1000):
        numbers = [d(rng.randrange(1, 7)), f"{d(4)}-{d(2)}-{d(2)}", f"{d(1)}.{d(1)}.{d(2)}", f"{d(2)},{d(3)}", f"${d(3)}.{d(2)}", f"{d(1)},{d(3)},{d(3)}", f"({d(4)})", "look at the dot on it"]
        text = " ".join(rng.choice([*COMMON, *numbers]) for _ in range(30))
        found += sum(bool(s["layer"]) for s in pii.spans_of(text, weights))
    assert found <= 5


# Licences

LINES = {
    "MIT License": "mit", "Licensed under MIT.": "mit", "License: GPLv3": "gpl-3.0", "Apache-2.0": "apache-2.0", "Released under the MIT License.": "mit",
    "Licensed under the Mozilla Public License 2.0": None, "This library is free under the GNU Lesser General Public License version 2.1": None,
}
#: Wordings that aren't among the templates, names or carriers.
HELD_OUT = {
    "You can use all of this under the terms of the MIT licence.": "mit",
    "Our package: MIT licensed, see the file": "mit",
    "Everything in here falls under the MIT License": "mit",
    "We publish the tool under Apache License 2.0": "apache-2.0",
    "It is open source under the Apache License, Version 2.0, since last year": "apache-2.0",
    "Sources are Apache-2.0 licensed": "apache-2.0",
    "You may share it under the GNU General Public License, version 3 or later": "gpl-3.0",
    "The plugin is GPLv3 licensed": "gpl-3.0",
    "Parts of it are under the GNU GPL version 3": "gpl-3.0",
    "Pictures by the author, CC BY-NC 4.0": "cc-by-nc-4.0",
    "All texts are under a Creative Commons BY-NC 4.0 licence": "cc-by-nc-4.0",
    "The data set is offered under CC BY 4.0": "cc-by-4.0",
    "Figures may be used under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
    "It has a BSD 3-Clause License": "bsd-3-clause",
    "the driver needs a new license for the car": None,
    "no part of the licence fee was paid back": None,
    "The parser comes under the Eclipse Public License 2.0": None,
    "Das Haus mit dem Garten ist mit Abstand das beste": None,
    "the public works of the general and his creative friends": None,
}


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(COMMON) for _ in range(n))


@pytest.mark.parametrize("titles", [0, 40])
def test_licence_lines_in_a_corpus_that_holds_them(spark, titles):
    rng = random.Random(titles)
    clean = [f"{prose(rng, 40)}.\n{prose(rng, 30)}." for _ in range(100)]
    texts = [f"{prose(rng, 20)}.\n{line}\n{prose(rng, 12)}." for line in LINES] + [f"MIT License\n\n{t}" if i < titles else t for i, t in enumerate(clean)]
    rows = licences.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = {(i, f) for i, f in enumerate(LINES.values()) if f} | {(len(LINES) + i, "mit") for i in range(titles)}
    assert {(r["doc_id"], r["family"]) for r in rows} == want


def test_licence_recall_and_precision_on_held_out_wordings(spark):
    rng = random.Random(3)
    texts = [f"{prose(rng, 20)}.\n{line}\n{prose(rng, 12)}." for line in HELD_OUT] + [f"{prose(rng, 60)}." for _ in range(80)]
    rows = licences.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {(r["doc_id"], r["family"]) for r in rows}
    want = {(i, f) for i, f in enumerate(HELD_OUT.values()) if f}
    assert len(found & want) >= 0.9 * len(want)
    assert len(found & want) >= 0.9 * len(found)
