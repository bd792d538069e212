"""The matcher as columns against the matcher as plain functions, and the cases that define it."""

import random
import unicodedata

from pyspark.sql import functions as F

from lethe.operators.match import leftovers, masked, matched, term_lists
from lethe.plans.redact import redact

CASES = [
    ("Ann met Annabel and ann", ["Ann"], [(0, 3)]),
    ("Will you? Yes, will do. Will.", ["Will"], [(0, 4), (24, 28)]),
    ("anna JONES and Anna\nJones", ["Anna Jones"], [(0, 10), (15, 25)]),
    ("07700900123 07700-900123 07700 900123", ["07700 900123"], [(0, 11), (12, 24), (25, 37)]),
    ("Maggie's (Maggie)", ["Maggie"], [(0, 6), (10, 16)]),
    ("14/03/1941 and 14/03/19-41", ["14/03/1941"], [(0, 10), (15, 26)]),
    ("xx xx", ["xx", ""], [(0, 2), (3, 5)]),
    ("ab cd ef", ["cd ef"], [(3, 8)]),
    ("ﬁne fine", ["ﬁne"], [(4, 8)]),
    ("a.b (c) [d]", ["(c)", "a.b"], [(0, 3), (4, 7)]),
    ("", ["x"], []),
]


def _run(spark, cases):
    units = spark.createDataFrame([(i, 0, c[0]) for i, c in enumerate(cases)], "doc_id long, unit_id int, text string")
    terms = spark.createDataFrame([(i, j, t, f"[T {j}]") for i, c in enumerate(cases) for j, t in enumerate(c[1])], "doc_id long, ord int, text string, label string")
    rows = matched(units, term_lists(terms), "left").select("doc_id", "spans", masked(F.col("text"), F.col("spans")).alias("m"))
    return {r["doc_id"]: ([(x["s"], x["e"], x["label"]) for x in r["spans"]], r["m"]) for r in rows.collect()}


def test_cases(spark):
    got = _run(spark, CASES)
    for i, (text, _, want) in enumerate(CASES):
        assert [x[:2] for x in got[i][0]] == want, text


def test_longest_label_wins_and_touching_spans_stay(spark):
    got = _run(spark, [("Margaret Jones and Jones", ["Jones", "Margaret Jones"]), ("abcd12", ["abcd", "12"])])
    assert got[0] == ([(0, 14, "[T 1]"), (19, 24, "[T 0]")], "[T 1] and [T 0]")


def _plain_spans(text, terms):
    """Spans of (term, label) by trying every place of the text, character by character."""
    space = lambda c: c in " \t\n"

    def length(term, at):
        digits, solid = sum(c.isdigit() for c in term), sum(not space(c) for c in term)
        number = digits >= 6 and digits * 10 >= solid * 6
        wanted = [c for c in term if c not in " \t\n.-"] if number else list(term)
        i, j = at, 0
        while j < len(wanted):
            if not number and space(wanted[j]):
                if i >= len(text) or not space(text[i]):
                    return 0
                while j < len(wanted) and space(wanted[j]):
                    j += 1
                while i < len(text) and space(text[i]):
                    i += 1
                continue
            if number and j and i < len(text) and (space(text[i]) or text[i] in ".-"):
                i += 1
            if i >= len(text) or text[i].lower() != wanted[j].lower():
                return 0
            i, j = i + 1, j + 1
        return i - at

    hits = []
    for order, (term, label) in enumerate(terms):
        term = unicodedata.normalize("NFKC", term.strip())
        at = 0
        while term and at < len(text):
            n = length(term, at)
            if not n:
                at += 1
                continue
            m = text[at : at + n]
            inside = (term[0].isalnum() and at and text[at - 1].isalnum()) or (term[-1].isalnum() and text[at + n : at + n + 1].isalnum())
            strict = term[0].isupper() and not any(space(c) or c.isdigit() or c == "@" for c in term)
            if not inside and (not strict or m[0].isupper()):
                hits.append((at, -n, order, at + n, label))
            at += n
    out = []
    for a, neg, _, z, label in sorted(hits):
        if out and a < out[-1][1]:
            old = out[-1]
            out[-1] = (old[0], max(z, old[1]), label if neg < old[3] else old[2], min(neg, old[3]))
        else:
            out.append((a, z, label, neg))
    return [o[:3] for o in out]


def test_random_strings_agree_with_plain_functions(spark):
    rng = random.Random(3)
    alphabet = ["a", "B", "ab", " ", "\n", "1", "23", ".", "-", "é", "Ab", "(", "😀"]
    cases = [("".join(rng.choices(alphabet, k=rng.randint(0, 25))), ["".join(rng.choices(alphabet, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 4))]) for _ in range(200)]
    got = _run(spark, cases)
    for i, (text, terms) in enumerate(cases):
        want = _plain_spans(text, [(t, f"[T {j}]") for j, t in enumerate(terms)])
        assert got[i][0] == want, (text, terms)


def test_all_of_many_terms_are_masked_or_refused(spark):
    mails = [f"person{i}@example.org" for i in range(700)]
    units = spark.createDataFrame([(1, 0, " and ".join(mails) + " wrote"), (2, 0, "Ann " * 3)], "doc_id long, unit_id int, text string")
    terms = spark.createDataFrame([(1, i, m, "[Email]") for i, m in enumerate(mails)] + [(2, 0, "Ann", "[Ann]")] * 3, "doc_id long, ord int, text string, label string")
    result, refused = redact(units, terms)
    assert [(r["doc_id"], r["text"], r["removed"]) for r in result.collect()] == [(1, " and ".join(["[Email]"] * 700) + " wrote", 700)]
    assert [(r["doc_id"], r["text"], r["reason"]) for r in refused.collect()] == [(2, "Ann", "label_collision")]
    assert leftovers(units.where("doc_id = 1"), term_lists(terms)).count() == 700


def test_masked_text_has_no_leftovers_but_label_words(spark):
    units = spark.createDataFrame([(1, 0, "Ann Lee and Bob"), (2, 0, "A Person came"), (3, 0, None)], "doc_id long, unit_id int, text string")
    terms = spark.createDataFrame([(1, 0, "Ann Lee", "[Person 1]"), (1, 1, "Bob", "[Person 2]"), (2, 0, "Person", "[Person 1]")], "doc_id long, ord int, text string, label string")
    result, refused = redact(units, terms)
    assert sorted((r["doc_id"], r["text"]) for r in result.collect()) == [(1, "[Person 1] and [Person 2]"), (3, "")]
    assert [(r["doc_id"], r["reason"]) for r in refused.collect()] == [(2, "label_collision")]
    assert leftovers(units.where("doc_id = 1"), term_lists(terms)).count() == 2
