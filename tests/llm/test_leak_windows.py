"""Windows searched together against one by one, short budgets, templates, and op9's buckets."""

import random
import time

import numpy as np
import pytest

from barloom.llm import decontaminate


def edited(rng, item, edits, signs):
    x = list(item)
    for _ in range(edits):
        k = rng.randrange(len(x)) if x else 0
        x[k : k + 1] = rng.choice([[], [rng.choice(signs)], [*x[k : k + 1], rng.choice(signs)]])
    return "".join(x)


def plain_distance(item, text):
    """(least edit distance of the item to any stretch of text, first end of one with it)."""
    row = list(range(len(item) + 1))
    best = (row[-1], 0)
    for at, sign in enumerate(text, 1):
        last, row[0] = row[0], 0
        for j in range(1, len(item) + 1):
            last, row[j] = row[j], min(last + (item[j - 1] != sign), row[j] + 1, row[j - 1] + 1)
        best = min(best, (row[-1], at))
    return best


@pytest.mark.parametrize("lot", [50, 4_000_000])
def test_windows_together_equal_plain_distance(monkeypatch, lot):
    monkeypatch.setattr(decontaminate, "LOT_CHARS", lot)
    rng = random.Random(5)
    for _ in range(40):
        signs = rng.choice(["ab ", "abcdefghé日😀 "])
        items = ["".join(rng.choice(signs) for _ in range(rng.choice([1, 20, 63, 64, 65, 128, 130, 200]))) for _ in range(4)]
        text = "".join(edited(rng, rng.choice(items), rng.randint(0, 5), signs) for _ in range(4))
        which, starts, ends = [], [], []
        for _ in range(12):
            a = rng.randint(0, max(0, len(text) - 1))
            which.append(rng.randrange(4))
            starts.append(a)
            ends.append(min(len(text), a + rng.randint(0, 150)))
        best, end = decontaminate.myers_together(items, np.array(which), text, np.array(starts), np.array(ends))
        for w, a, b, d, e in zip(which, starts, ends, best.tolist(), end.tolist()):
            assert (d, e) == plain_distance(items[w], text[a:b])
            assert (d, e) == decontaminate.myers(decontaminate.masks_of(items[w]), len(items[w]), text[a:b])


def test_hits_are_the_same_either_way(monkeypatch):
    rng, found = random.Random(6), 0
    for _ in range(60):
        items = [(k, decontaminate.normal("".join(rng.choice("ab c") for _ in range(rng.randint(10, 200))))) for k in range(8)]
        text = decontaminate.normal(" ".join(edited(rng, rng.choice(items)[1], rng.randint(0, 6), "abz ") for _ in range(10)))
        got = []
        for bound in (1, 10**9):
            monkeypatch.setattr(decontaminate, "TOGETHER", bound)
            got.append(decontaminate.Matcher(items).hits(text))
        assert got[0] == got[1]
        found += len(got[0])
        # No item that occurs within its budget is missed.
        for i, item in items:
            if decontaminate.budget(len(item)):
                d, e = plain_distance(item, text)
                assert ([(h[1], h[3]) for h in got[0] if h[0] == i] == [(d, e)]) == (d <= decontaminate.budget(len(item)))
    assert found > 50


def test_items_of_a_template_in_a_long_text():
    rng = random.Random(1)
    phrase = "what is the capital city of the country "
    items = [(k, decontaminate.normal(phrase + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 60))))) for k in range(300)]
    text = decontaminate.normal(" ".join(phrase + "".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(2500)))[:120_000] + " " + items[7][1]
    matcher = decontaminate.Matcher(items)
    began = time.time()
    got = matcher.hits(text)
    assert time.time() - began < 30
    assert (7, 0, 120_001, 120_001 + len(items[7][1])) in got


@pytest.mark.parametrize("m, errors", [(19, 0), (20, 1), (31, 1), (39, 1), (40, 2), (47, 2), (60, 3), (63, 3), (80, 4), (400, 20)])
def test_short_items_have_their_whole_budget(m, errors):
    rng = random.Random(m)
    assert decontaminate.budget(m) == errors
    for _ in range(30):
        item = "".join(rng.choice("abcdefghijklmnop") for _ in range(m))
        assert all(len(p) >= decontaminate.GRAM for _, p in decontaminate.pieces(item)) or not errors
        got = decontaminate.Matcher([(1, item)]).hits("zz " + edited(rng, item, errors, "qrstuv") + " zz")
        assert len(got) == 1 and got[0][1] <= errors
    if not errors:
        # Without an error to spare an item stands as words.
        assert decontaminate.Matcher([(1, item)]).hits(f"zz{item}zz") == []


def test_short_budgets_by_piece_too(spark, monkeypatch):
    rng = random.Random(2)
    items = ["".join(rng.choice("abcdefghij") for _ in range(m)) for m in (22, 30, 45, 62, 90, 150)]
    texts = [f"some words before {edited(rng, item, decontaminate.budget(len(item)), 'qrst')} and after" for item in items for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    plain = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "FEW_BLOCKS", 0)
    assert sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect())) == plain and len(plain) >= 18
