"""The automaton of long lists against the rule, one expression a term."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lethe.operators import search
from lethe.operators.match import leftovers, matched, redacted, term_lists
from lethe.operators.search import Automaton, Few, Searcher, folded, occurrences

SIGNS = ["a", "A", "b", "B", " ", "  ", "\n", " ", ".", "-", "1", "2", "3", "ß", "ẞ", "ſ", "s", "İ", "i", "ı", "K", "k", "é", "É", "ﬁ", "(", "'", "Σ", "σ", "ς", "ŉ", "ΐ", ""]


def test_folding_is_as_coarse_as_case_insensitive_expressions():
    for point in range(0x110000):
        c = chr(point)
        for d in {c.lower(), c.upper(), c.swapcase()} - {c}:
            if len(d) == 1 and re.fullmatch(re.escape(c), d, re.I):
                assert folded(c) == folded(d), hex(point)
    for same in ("iıİI", "sſS", "kK", "µμΜ", "σςΣ", "ﬅﬆ"):
        assert len({folded(c) for c in same}) == 1
    for text in ("Straße ẞ", "plain", "ΑΣ ΑΣ", "ŉ ﬁ İ ß"):
        assert folded(text) == "".join(folded(c) for c in text) and len(folded(text)) == len(text)


@pytest.mark.parametrize("seed", range(3))
def test_random_strings(seed):
    rng, found = random.Random(seed), 0
    for _ in range(1500):
        signs = rng.sample(SIGNS, rng.randint(3, 12))
        pick = lambda n, of: "".join(rng.choice(of) for _ in range(n))
        terms = [(i, pick(rng.randint(0, 5), signs) if rng.random() < 0.7 else pick(rng.randint(6, 10), ["1", "2", "3", " ", ".", "-", "a"]), f"[{rng.choice(signs)}]") for i in range(rng.randint(0, 30))]
        text = pick(rng.randint(0, 60), signs) + "".join(rng.choice(terms)[1].replace(" ", "  ") for _ in range(3) if terms)
        want = occurrences(text, terms)
        found += len(want)
        assert Automaton(tuple(terms)).occurrences(text) == want, (text, terms)
        within = {o for o, t, _ in terms if (c := search._compiled(t)) and any(c[0].search(x) for _, _, x in terms)}
        for how in (Automaton, Few):
            both = Searcher(tuple(terms))
            both._how = how(tuple(terms))
            assert both.within_labels() == within
    assert found > 1000


def test_the_time_is_that_of_the_text():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(4000)]
    text = " ".join(rng.choices(words, k=60_000))
    seconds = []
    for n in (2_000, 20_000):
        automaton = Automaton(tuple((i, f"{rng.choice(words)} {rng.choice(words)} {i % 7}", "[x]") for i in range(n)))
        automaton.occurrences("warm")
        began = time.process_time()
        automaton.occurrences(text)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 4 * seconds[0] + 0.2 and seconds[1] < 2


def test_long_lists_as_columns(spark):
    terms = [(i, f"Name{i} Lee", f"[Person {i}]") for i in range(60)] + [(60, "person", "[Person 60]")]
    units = spark.createDataFrame([(1, 0, "name3  LEE met Name59\nLee and Name3 Leeds"), (2, 0, "a Person"), (3, 0, None)], "doc_id long, unit_id int, text string")
    own = term_lists(spark.createDataFrame([(d, *t) for d in (1, 2, 3) for t in terms], "doc_id long, ord int, text string, label string"))
    one = term_lists(spark.createDataFrame(terms, "ord int, text string, label string"), ())
    for lists in (own, one):
        out = {r["doc_id"]: (r["text"], r["removed"]) for r in redacted(units, lists).collect()}
        assert out == {1: ("[Person 3] met [Person 59] and Name3 Leeds", 2), 2: ("a [Person 60]", 1), 3: ("", 0)}
        left = {(r["doc_id"], r["text"], r["reason"]) for r in leftovers(units, lists).collect()}
        assert left == {(1, "Name3 Lee", "present"), (1, "Name59 Lee", "present"), (2, "person", "label_collision")}
    with pytest.raises(ValueError):
        matched(units, own.select("terms"))
    assert matched(units, one.limit(0)).select(F.sum(F.size("hits"))).first()[0] == 0
