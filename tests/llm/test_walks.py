"""Decontamination by walks: recall by place of edits, against the exact search, and odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegate.llm import decontaminate, walks
from tests.llm.conftest import rows_of

KINDS = ("changed", "left out", "put in")


def drawn(seed, sizes):
    """Items of skewed words, some of them frequent as in prose."""
    dice = random.Random(seed)
    words = [f"{dice.randrange(10**6):06d}"[: dice.randrange(2, 7)] for _ in range(3000)]
    draw = lambda k: [words[int(3000 * dice.random() ** 3)] for _ in range(k)]
    return [draw(k) for k in sizes], draw


@pytest.fixture(scope="module")
def planted(spark):
    """Documents with every item at its most edits: by place and kind of edits, and without any."""
    items, draw = drawn(5, [*range(1, 90), 150, 400])
    dice, rows, what = np.random.default_rng(8), [], []
    for number, item in enumerate(items):
        edits = len(item) // 5
        for place in ("none", "begin", "middle", "end", "even", "spread"):
            for kind in KINDS if place in ("begin", "middle", "end") else ("mixed",):
                if place == "none":
                    text = item
                elif kind == "mixed":
                    own = walks.edited(np.arange(len(item), dtype=np.uint64), edits, place, dice)
                    text = [item[x] if x < len(item) else f"new{x}" for x in own.tolist()]
                else:
                    at = {"begin": 0, "middle": (len(item) - edits) // 2, "end": len(item) - edits}[place]
                    text = item[:at] + ([] if kind == "left out" else [f"new{i}" for i in range(edits)]) + item[at + (edits if kind != "put in" else 0) :]
                rows.append((len(rows), " ".join(draw(30) + text + draw(30))))
                what.append((number, place))
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    return documents, benchmark, what, items


def test_recall_by_place_of_edits(planted):
    documents, benchmark, what, items = planted
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents, benchmark).collect()}
    caught = {}
    for doc, (number, place) in enumerate(what):
        for group in (place, f"class {walks.size_class(len(items[number]))}" if place != "none" else "none"):
            caught.setdefault(group, []).append((doc, number) in found)
    recall = {k: sum(x) / len(x) for k, x in caught.items()}
    assert recall["none"] == 1 and min(recall.values()) >= 0.9, recall


def test_walks_against_the_exact_search(planted):
    documents, benchmark, *_ = planted
    exact = {(r.doc_id, r.item_id): r.edits for r in decontaminate.exact_leaks(documents, benchmark).collect()}
    found = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(documents, benchmark).collect()}
    assert set(found) <= set(exact) and len(found) >= 0.95 * len(exact)
    assert all(edits >= exact[pair] for pair, edits in found.items())


def test_generated_documents_give_what_the_exact_search_gives(spark, sf):
    documents, benchmark = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "benchmark"))
    exact = rows_of(decontaminate.exact_leaks(documents, benchmark).select("doc_id", "item_id").distinct())
    found = rows_of(decontaminate.leaks(documents, benchmark).select("doc_id", "item_id").distinct())
    assert set(found) <= set(exact) and len(found) >= 0.9 * len(exact)


def test_texts_of_many_blocks_and_long_items(spark):
    """An item longer than a block; one text that holds a short item very often; copies of it; huge ids."""
    long_item, short = " ".join(f"w{i}" for i in range(3000)), "five plain words stand here"
    items = spark.createDataFrame([(2**62 + 1, long_item), (None, short), (2**62 + 1, long_item)], "item_id long, text string")
    rows = [(0, "start " + long_item), (1, (short + " and ") * 5000), (2, (short + " and ") * 5000), (2**63 - 1, short), (None, "x " * 50 + short)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_key", F.lit(1)).withColumn("item_id", F.lit("x"))
    want = [(0, 2**62 + 1, 0, 1, 3001), (1, None, 0, 0, 5), (2, None, 0, 0, 5), (2**63 - 1, None, 0, 0, 5), (None, None, 0, 50, 55)]
    assert rows_of(decontaminate.leaks(documents, items)) == sorted(want, key=str)
    clean = decontaminate.clean_documents(documents.unionByName(documents.limit(1).withColumn("text", F.lit(None).cast("string"))), items)
    assert clean.columns == documents.columns and clean.count() == 1


def test_a_full_bitmap_changes_no_result(planted, monkeypatch):
    documents, benchmark, *_ = planted
    some = documents.filter("doc_id < 60")
    want = rows_of(decontaminate.leaks(some, benchmark))
    full = np.arange(1 << (decontaminate.BITS - 6)), np.full(1 << (decontaminate.BITS - 6), -1)
    monkeypatch.setattr(decontaminate, "bitmap", lambda keys: full)
    found = rows_of(decontaminate.leaks(some, benchmark))
    assert {x[:2] for x in want} <= {x[:2] for x in found}


def test_walks_stay_inside_their_item():
    for size in (1, 2, 5, 17, 48, 300):
        for start in walks.starting_words(size):
            window = walks.size_class(size - start)
            assert start + max(walks.walk(window, 0).places) < size
    assert walks.starting_words(1) == [0] and 0 in walks.starting_words(300)
