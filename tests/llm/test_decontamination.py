"""Benchmark decontamination against a search of every window, for short, usual and very long items."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

import pytest

from fadewell.llm import decontaminate

SCHEMA = "item_id long, text string"


def words(rng, n, pool=4000):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def shingles(text, k):
    w = (text or "").lower().split()
    k = min(k, len(w))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []


def brute_matches(items, texts, similarity=0.8):
    """(document, item) with a window of the item's length in shingles whose weighted Jaccard similarity is enough."""
    bags = {i: Counter(shingles(t, 5)) for i, t in items if (t or "").split()}
    held = Counter(g for b in bags.values() for g in b)
    weight = lambda g: math.log1p(len(bags) / held[g]) if g in held else math.log1p(len(bags))
    found = set()
    for i, bag in bags.items():
        n, k = sum(bag.values()), len(next(iter(bag)))
        for d, text in enumerate(texts):
            grams = shingles(text, k)
            if not set(grams) & bag.keys():
                continue
            for s in range(max(1, len(grams) - n + 1)):
                if bag.keys().isdisjoint(grams[s : s + n]):
                    continue
                window = Counter(grams[s : s + n])
                both, either = (sum(weight(g) * f(window[g], bag[g]) for g in window.keys() | bag.keys()) for f in (min, max))
                if both / either >= similarity:
                    found.add((d, i))
                    break
    return found


def changed(rng, text):
    w = text.split()
    for _ in range(rng.choice([0, 0, 1, 1, 2])):
        at = rng.randrange(max(1, len(w)))
        w[at : at + 1] = rng.choice([[], ["other"], [*w[at : at + 1], "more"]])
    return " ".join(w)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    lengths = [1, 2, 3, 4, 5, 6, 8, 11, 12, 13, 15, 20, 27, 33, 40, 48, 59, 75, 120, 300, 700]
    items = [(n, words(rng, n)) for n in lengths] + [(9001, None), (9002, " "), (9003, words(rng, 3, 3)), (9004, "a a a a a a a a a a")]
    texts = [None, "", "w1", *[words(rng, rng.randint(1, 400)) for _ in range(60)]]
    for _, t in items * 12:
        if (t or "").split():
            texts.append(" ".join((words(rng, rng.randint(0, 90)), changed(rng, t).upper(), words(rng, rng.randint(0, 90)))))
    return items, texts


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(4)


@pytest.mark.parametrize("per_shard", [20_000, 6])
def test_every_window(spark, case, per_shard):
    items, texts = case
    want = brute_matches(items, texts)
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 id", "2 f", "3 item_id", "4 first_word", "5 grams", "6 shard")
    bench = frame(spark, items, SCHEMA).selectExpr("*", "1 id", "2 shard", "3 gram")
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark, docs, bench, per_shard=per_shard).collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    # windows begin every sixteenth of their length on a grid of lengths: all but a few of the edited passages
    assert len(got) >= 0.99 * len(want) and len(want) > 100


def test_split_does_not_change_similarities(spark, case):
    items, texts = case
    docs, bench = frame(spark, list(enumerate(texts)), "doc_id long, text string"), frame(spark, items, SCHEMA)
    one, many = (sorted(decontaminate.contaminated(spark, docs, bench, per_shard=n).collect()) for n in (20_000, 4))
    assert one == many


def test_short_items_inside_longer_texts():
    index = decontaminate.Index([(1, "alpha beta gamma delta"), (2, "omega")])
    texts = ["some words then Alpha beta gamma delta and more", "alpha beta gamma", "the omega", "omegas"]
    assert index.matches(texts) == [[(1, 3, 1.0)], [], [(2, 1, 1.0)], []]


@pytest.mark.parametrize("n", [8_000, 20_000, 70_000, 140_000])
def test_long_items(n):
    rng = random.Random(n)
    item = words(rng, n, 100_000).split()
    for _ in range(n // 100):
        item[rng.randrange(n)] = "other"
    index = decontaminate.Index([(5, " ".join(item)), (6, words(rng, 30))])
    near = item[: n // 2] + ["changed"] + item[n // 2 + 1 :]
    texts = [words(rng, k) + " " + " ".join(t) + " " + words(rng, 900) for k, t in ((1, item), (777, near), (n // 3, near))] + [" ".join(item), " ".join(item[: n // 2])]
    begin = time.time()
    found = index.matches(texts)
    assert [[(i, s) for i, s, v in f] for f in found] == [[(5, 1)], [(5, 777)], [(5, n // 3)], [(5, 0)], []]
    assert found[0][0][2] == 1 and time.time() - begin < 5 + n / 4_000


def test_empty_tables(spark, case):
    items, texts = case
    docs, bench = frame(spark, list(enumerate(texts)), "doc_id long, text string"), frame(spark, items, SCHEMA)
    assert decontaminate.contaminated(spark, docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(spark, docs, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == len(texts)
