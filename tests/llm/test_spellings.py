import itertools
import random
import re

from loomgraph.llm import spellings as sp
from loomgraph.session import Cut

A = "https://id.example/agent/"
T = "subject string, subject_label string, predicate string, object string, object_label string, uri_a string"
V = "name string, label string"


def _tables(spark, people, extra=()):
    """people: (number, label, year, place)"""
    triples = [(A + str(n), label, "http://x/birth_year", year, None, "clash") for n, label, year, _ in people if year]
    triples += [(A + str(n), label, "http://x/P74_has_current_or_former_residence", "https://id.example/place/" + place, "", "clash") for n, label, _, place in people if place]
    triples += [("https://id.example/work/1", "w", "http://x/P14_carried_out_by", A + str(n), label, "clash") for n, label, *_ in people]
    types = [(A + str(n), "http://x/E21_Person") for n, *_ in people]
    return spark.createDataFrame([*triples, *extra], T), spark.createDataFrame([(A + str(n), label) for n, label, *_ in people], V), spark.createDataFrame(types, "uri string, type_uri string")


def run(spark, people, extra=()):
    found = sp.same_entities(*_tables(spark, people, extra))
    return {tuple(int(x[len(A):]) for x in r) for r in found.collect()}


def test_variants_are_linked_and_namesakes_kept_apart(spark):
    people = [
        (1, "Charlotte Falkeckabezza", "1766", "p1"), (2, " FALKECKABEZZA, CHARLOTTE", "+1766", None), (3, "Falkeckabezza, Lotte", None, "p1"), (4, "Charl0tte Falkekabezza", "1766.0", "p1"),
        (5, "Giuseppe Holvilodini", "1760", None), (6, "Holvilodini, Giuseppe", "1816", None), (7, "Dr. G. Holvilodini, Maler", "1816", None),
        (8, "Augusta van Silvelodigny (1921–1990)", "1921", "p2"), (9, "AugustavanSilvelodigny", "1921", "p2"), (10, None, "1921", "p2"), (11, "11", "1921", "p2"), (12, "  ", "1921", "p2"),
        (13, "Tordomova, Josephine", None, None), (14, "Josephine Tordomova", None, None), (15, "x" * 3000, "1500", None),
    ]
    expected = {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (6, 7), (8, 9), (13, 14)}
    assert run(spark, people, [(None, None, None, None, None, None)]) == expected
    assert run(spark, people + people) == expected


def test_a_namesake_of_another_year_parts_nobody(spark):
    people = [(1, "Smith John", "1766", None), (2, "John Smith", "1766", None), (3, "John Smith", "1816", None)]
    # none of the other names starts a comparison, so that each word is frequent and only the groups of equal words are left
    many = [(n, f"{w} X", str(n), None) for w, at in (("Smith", 100), ("John", 200)) for n in range(at, at + 90)]
    assert run(spark, people + many) == {(1, 2)}


def test_frequent_words_start_comparisons(spark):
    people = [(1, "Johanna Schneider", "1766", None), (2, "Johanna Schneidre", "1766", None), (3, "J. Schneider", "1766", None), (4, "Johanna Schneider", "1816", None), (5, "Peter Schneider", "1766", None)]
    many = [(n, f"{w} {x}", str(n + 1000), None) for w, x, at in (("Schneider", "Xaver", 100), ("Johanna", "Xenia", 200)) for n in range(at, at + 90)]
    assert {(1, 2), (1, 3)} <= (got := run(spark, people + many)) and not any(4 in x or 5 in x for x in got)


def test_nicknames_of_another_initial_beside_frequent_words(spark):
    people = [(1, "William Falkeckabezza", "1700", "p1"), (2, "Bill Falkeckabezza", "1700", "p1"), (3, "William Tordessalska", "1701", "p2"), (4, "Bill Tordessalska", "1701", "p2")]
    # Lang is short, Schneider has many bearers
    people += [(5, "William Lang", "1766", None), (6, "Bill Lang", "1766", None), (7, "Bill Lang", "1816", None), (8, "Anna Lang", "1766", None), (11, "William Schneider", None, "p3"), (12, "Bill Schneidre", None, "p3")]
    many = [(n, "Schneider Xaver", str(n + 1000), None) for n in range(100, 190)]
    assert run(spark, people + many) == {(1, 2), (3, 4), (5, 6), (11, 12)}


def test_no_plan_takes_in_all_kinds_of_links(spark, monkeypatch):
    # a plan is planned again after each of its stages, and the driver keeps what it was each time
    people = [(1, "William Falkeckabezza", "1700", "p1"), (2, "Bill Falkeckabezza", "1700", "p1"), (3, "William Tordessalska", "1701", "p2"), (4, "Bill Tordessalska", "1701", "p2"), (5, "William Lang", "1766", None), (6, "Bill Lang", "1766", None)]
    joins = []

    class Spied(Cut):
        def __init__(self, frame):
            joins.append(len(re.findall(r"\bJoin\b", frame._jdf.queryExecution().optimizedPlan().toString())))
            super().__init__(frame)

    monkeypatch.setattr(sp, "Cut", Spied)
    monkeypatch.setattr(sp, "cut", lambda frame: Spied(frame).df, raising=False)
    assert run(spark, people) == {(1, 2), (3, 4), (5, 6)}
    assert max(joins) <= 4


def test_misspelt_surnames_meet_without_a_common_fact(spark):
    people = [(1, "Antonia Tordessalska", "1766", None), (2, "Tordessalka, Antonia", None, "p1"), (3, "Maria Tordessalksa", None, None), (4, "Clara Falkeckabezza", "1700", None), (5, "Clara Falkekabezza", None, "p1"), (6, "Clara Falkeckabeza", "1800", None)]
    assert run(spark, people) == {(1, 2)}  # 5 may be 4 or 6


def test_segments_find_all_words_within_the_edits(spark):
    rng = random.Random(2)
    letters = "abcdefgh"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(5, 14))) for _ in range(60)}
    for w in list(words):
        w2 = list(w)
        for _ in range(rng.randrange(1, 3)):
            at = rng.randrange(len(w2))
            rng.choice([lambda: w2.insert(at, rng.choice(letters)), lambda: w2.pop(at), lambda: w2.__setitem__(at, rng.choice(letters))])()
        words.add("".join(w2))
    words = sorted(w for w in words if len(w) >= 5)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def swap(a, b):
        return distance(a, b) == 2 and len(a) == len(b) and sorted(a) == sorted(b)

    expected = {(a, b) for a, b in itertools.product(words, words) if distance(a, b) <= (1 if min(len(a), len(b)) < 8 else 2) or swap(a, b)}
    found = sp.similar_words(spark.createDataFrame([("f", w) for w in words], "fact string, word string")).collect()
    assert {(r["word"], r["other"]) for r in found} == expected


def test_swaps_and_short_names(spark):
    people = [(1, "Clara Ulfinow", "1766", None), (2, "Clara Ulfinwo", "1766", None), (3, "Anna Kern", "1800", None), (4, "Ana Kern", "1800", None), (5, "Anna Kern", "1801", None), (6, "Otto Kern", "1800", None)]
    assert run(spark, people) == {(1, 2), (3, 4)}


def test_words_that_tell_nothing_are_learnt(spark):
    names = ["Clara Tordessalska", "Anton Falkeckabezza", "Peter Holvilodini", "Maria Silvelodigny", "Ursula Tordomova", "Ignaz Velkardekkow"]
    people = [(2 * i + j, name + " Obermeister" * j, str(1700 + i), f"p{i}") for i, name in enumerate(names) for j in (0, 1)]
    told, known = sp.agents(*_tables(spark, people)[:2])
    assert sp.optional_words(told.join(known, "uri", "left")) == ["obermeister"]
    assert run(spark, people) == {(2 * i, 2 * i + 1) for i in range(len(names))}


def test_banded_edits_and_parts():
    assert sp._edits("walvansen", "wlavansen", 1) and not sp._edits("abc", "xyz", 2) and sp._edits("", "a", 1)
    assert sp.compatible(["gld", "goldsmiths"], ["guild", "goldsmiths"], set()) and not sp.compatible(["guild", "goldsmiths"], ["guild", "glassmakers"], set())
    assert sp.compatible(["ul"], ["university", "library"], set()) and sp.compatible(["c"], ["charlotte", "maria"], set())


def test_empty(spark):
    none = sp.same_entities(spark.createDataFrame([], T), spark.createDataFrame([], V), spark.createDataFrame([], "uri string, type_uri string"))
    assert none.count() == 0 and none.columns == ["uri_a", "uri_b"]
