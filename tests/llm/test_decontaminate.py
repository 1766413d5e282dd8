import re

import duckdb
import pytest

from durata.llm import decontaminate as dc
from tests.conftest import SF_ORACLE, SF_SMALL

ITEM = "Alice buys 12 apples for 3 dollars each and gives Bob 4 of them how many apples remain with Alice"


def leaks(spark, texts, items, **kw):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in dc.leaks(d, b).collect()}


def test_verbatim_and_other_values(spark):
    other = ITEM.replace("Alice", "Carol").replace("Bob", "Dan").replace("12", "90").replace("dollars", "euros")
    torn = ITEM.replace("Alice buys", "Carol buys").replace("with Alice", "with Eve").replace("Bob", "Dan")
    filler = "some words before it that have nothing to do with the question and "
    got = leaks(spark, [ITEM, filler + ITEM + " more", filler + other, "nothing here " * 40, None, "", filler],
                [(1, ITEM), (2, "unrelated question about the height of very old towers in the north of some country")])
    assert set(got) == {(0, 1), (1, 1), (2, 1)}
    assert got[0, 1].exact and got[1, 1].exact and not got[2, 1].exact
    assert got[1, 1].first_word == len(filler.split())
    strict = leaks(spark, [torn], [(1, ITEM)])
    assert not strict or strict[0, 1].coverage < 1 or not strict[0, 1].exact


def test_inconsistent_slots_do_not_count(spark):
    item = "if X1 Tom walks 5 km and Tom runs 5 km then Tom rests for 5 minutes before Tom swims 5 km again"
    bad = "if X1 Ann walks 6 km and Ben runs 7 km then Cat rests for 8 minutes before Dan swims 9 km again"
    good = "if X1 Ann walks 6 km and Ann runs 6 km then Ann rests for 6 minutes before Ann swims 6 km again"
    got = leaks(spark, [bad, good], [(1, item)])
    assert set(got) == {(1, 1)}


def test_same_template_items_and_repeats(spark):
    a = "what is the sum of 3 and 4 when both are doubled and then halved again twice"
    b = a.replace("3", "8").replace("4", "9")
    got = leaks(spark, [a, a, "short one"], [(1, a), (2, b), (2, b), (3, None), (4, ""), (5, "too short")])
    assert set(got) == {(0, 1), (0, 2), (1, 1), (1, 2)}
    short = spark.createDataFrame([(5, "too short"), (6, None), (7, a)], "item_id long, text string")
    assert {r.item_id for r in dc.unmatchable(short).collect()} == {5, 6}


def test_short_items_and_empty_tables(spark):
    got = leaks(spark, ["we asked who wrote the long poem yesterday", "who wrote a poem"], [(1, "who wrote the long poem")])
    assert set(got) == {(0, 1)}
    assert leaks(spark, [], [(1, ITEM)]) == {}
    assert leaks(spark, [ITEM], []) == {}


def recall(spark, change):
    """Share of the benchmark's items found in documents that hold each of
    them changed, and documents that some other item was found in."""
    b = spark.read.parquet(f"{SF_ORACLE}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in b.collect()]
    lead, tail = "the lines before are of no matter here and ", " nor are those that come after it"
    d = spark.createDataFrame([(i, lead + change(t) + tail) for i, t in items], "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.item_id) for r in dc.leaks(d, b).collect()}
    return len([1 for i, _ in items if (i, i) in got]) / len(items), len({d for d, i in got if d != i})


def _at_middle(edit):
    def change(t):
        w = t.split()
        return " ".join(edit(w, len(w) // 2))
    return change


CHANGES = {
    "none": lambda t: t, "lower": str.lower, "upper": str.upper,
    "put in": _at_middle(lambda w, m: [*w[:m], "indeed", *w[m:]]),
    "left out": _at_middle(lambda w, m: [*w[:m], *w[m + 1:]]),
    "changed": _at_middle(lambda w, m: [*w[:m], "instead", *w[m + 1:]]),
    "two words put in": _at_middle(lambda w, m: [*w[:m // 2], "so", *w[m // 2:m], "indeed", *w[m:]]),
}


@pytest.mark.parametrize("how", list(CHANGES))
def test_changed_items_are_found(spark, how):
    share, others = recall(spark, CHANGES[how])
    assert share >= 0.9 and others == 0


def test_fillers_of_several_words(spark):
    """A name of two words, a number with a comma, one word put in or left out."""
    texts = [ITEM.replace("Bob", "Mary Ann"), ITEM.replace("4 of", "1,200 of"), ITEM.replace("how many", "how very many"),
             ITEM.replace("dollars each", "dollars"), ITEM.upper(), ITEM.lower(),
             ITEM.replace("Alice", "Jean Luc").replace("12", "3,000.50").replace("Bob", "Di")]
    got = leaks(spark, texts + ["Alice buys 12 apples", "many apples remain on trees with Alice for 3 days"], [(1, ITEM)])
    assert set(got) == {(i, 1) for i in range(len(texts))}


def test_items_of_few_words_are_found_as_they_stand(spark):
    poor, four = "Compute 12 * 7 + 45 - 3 and 8", "2 3 5 7"
    texts = [f"we asked: {poor} and more", poor.replace("45", "46"), "primes 2 3 5 7 and on", "7 5 3 2", poor.lower()]
    got = leaks(spark, texts, [(1, poor), (2, four), (3, "too short")])
    assert {(0, 1), (2, 2), (4, 1)} <= set(got) and (3, 2) not in got
    assert got[0, 1].exact and got[2, 2].exact


def test_rows_without_ids_repeats_and_long_texts(spark):
    d = spark.createDataFrame([(None, ITEM, 1), (None, ITEM, 2), (7, ITEM, 3), (7, "clean text of no matter", 4), (None, None, 5),
                               (8, "word " * 300_000 + ITEM + " word" * 300_000, 6)], "doc_id long, text string, uid int")
    b = spark.createDataFrame([(1, ITEM, "x"), (1, ITEM, "x"), (None, ITEM.replace("apples", "pears"), "y")],
                              "item_id long, text string, template string")
    got = sorted(((r.doc_id, r.item_id, r.exact) for r in dc.leaks(d, b).collect() if r.item_id == 1), key=repr)
    assert got == sorted([(None, 1, True), (None, 1, True), (7, 1, True), (8, 1, True)], key=repr)


def plain(t):
    return " ".join(re.findall(r"[0-9a-z\x80-\U0010FFFF]+", t.lower()))


def test_every_whole_item_is_found(spark):
    for sf in (SF_SMALL, SF_ORACLE):
        c = duckdb.connect()
        docs = c.execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
        items = [(i, plain(t)) for i, t in c.execute(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()]
        want = {(d, i) for d, t in docs for p in [f" {plain(t)} "] for i, q in items if f" {q} " in p}
        got = {(r.doc_id, r.item_id) for r in dc.leaks(spark.read.parquet(f"{sf}/documents.parquet"),
                                                       spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
        assert want <= got
        assert len(got - want) <= 0.1 * len(want) + 1


def test_items_of_one_form_are_judged_by_their_own_fillers(spark):
    a = "what is the sum of 3 and 3 when both are doubled and then halved again twice"
    b, c = a.replace("3 and 3", "3 and 5"), a.replace("3 and 3", "8 and 9")
    got = leaks(spark, [a, b], [(1, a), (2, b), (3, c)])
    assert {(1, 2), (1, 3), (0, 1)} <= set(got)
    assert got[0, 1].exact and got[1, 2].exact and not got[1, 3].exact
