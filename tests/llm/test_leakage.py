import random

import numpy as np
import pytest

from kolonnade.llm import leakage
from kolonnade.llm.leakage import changeable, leaked_items
from kolonnade.llm.words import Hasher, words

rng = random.Random(90_001)
VOCABULARY = [f"{a}{b}" for a in "bcdfghklmnprstvw" for b in ("alo", "eri", "ino", "oka", "utu", "ami", "est")]
ITEMS = [(i, " ".join(rng.choices(VOCABULARY, k=rng.randrange(26, 38))) + "?", " ".join(rng.choices(VOCABULARY, k=30)), f"SELECT {rng.choice(VOCABULARY)} FROM t{i} WHERE a_{i} = 'x y' ORDER BY b{i} LIMIT {i}") for i in range(30)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choices(VOCABULARY, k=n))


def changed(text, n, seed):
    r, w = random.Random(seed), text.split()
    for at in r.sample(range(len(w)), n):
        w[at] = "other"
    return " ".join(w)


def run(spark, docs, items=ITEMS):
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*x, "z") for x in items], "item_id int, question string, evidence string, gold_sql string, doc_id string")
    return sorted(map(tuple, leaked_items(d, i).collect()))


def test_variants(spark):
    q, e, s = ITEMS[3][1], ITEMS[4][2], ITEMS[5][3]
    docs = [
        (1, prose(400, 1) + " " + q + " " + prose(300, 2)), (2, changed(q, 4, 1) + " " + prose(50, 3)), (3, changed(e, 5, 2).replace("other", "different")), (4, prose(80, 4) + " " + " ".join(e.split()[8:20])),
        (5, prose(80, 5) + " " + " ".join(e.split()[8:19])), (6, "```sql\n" + s.replace(" ", "\n").lower() + ";\n```"), (7, s.replace("t5", "t6")), (8, "<p>" + " ".join(f"<b>{w}</b>" for w in q.upper().split()) + "</p>"),
        (9, "\n> ".join(q.split())), (10, "​".join(q)), (11, q.translate({ord(c): ord(c) + 0xFEE0 for c in "abcdefghijklmnopqrstuvwxyz"})), (12, None), (13, ""), (None, q), (14, q), (14, q), (15, prose(3000, 6)), (16, q + " " + e),
    ]
    got = run(spark, docs)
    # five words changed at random may still leave a quote of twelve words
    five = [(3, 4)] if holds(docs[2][1], e, False) else []
    assert got == sorted([(1, 3), (2, 3), (4, 4), (6, 5), (8, 3), (9, 3), (10, 3), (11, 3), (14, 3), (16, 3), (16, 4)] + five)


HASH = Hasher()


def holds(doc, text, exact):
    """Brute force: the text laid over the document at every place."""
    d, t = HASH(words(doc)), HASH(words(text))
    m = len(t)
    padded = np.zeros(len(d) + 2 * m, np.uint64)
    padded[m : m + len(d)] = d
    same = np.lib.stride_tricks.sliding_window_view(padded, m) == t
    whole = same[m : len(d) + 1].sum(axis=1) if len(d) >= m else np.zeros(0)
    if (whole >= m - (0 if exact else changeable(m))).any():
        return True
    run = np.zeros(len(same), int)
    for column in same.T:
        run = np.where(column, run + 1, 0)
        if not exact and (run >= 12).any():
            return True
    return False


def brute(docs, items):
    return sorted({(d, i) for d, text in docs for i, q, e, s in items for t, exact in ((q, False), (e, False), (s, True)) if t and holds(text, t, exact)})


def test_against_every_text_tried(spark):
    r, docs = random.Random(4), []
    for d in range(300):
        item = r.choice(ITEMS)
        text = r.choice(item[1:3])
        piece = {0: text, 1: changed(text, r.randrange(1, 7), d), 2: " ".join(text.split()[r.randrange(8) :][: r.randrange(9, 17)]), 3: item[3]}[d % 4]
        docs.append((d, f"{prose(r.randrange(5, 900), d)} {piece} {prose(r.randrange(5, 400), d + 1)}"))
    assert run(spark, docs) == brute(docs, ITEMS)


def test_short_texts_with_changed_words(spark):
    r = random.Random(5)
    items = [(i, " ".join(r.choices(VOCABULARY, k=1 + i % 24)), " ".join(r.choices(VOCABULARY, k=1 + i * 7 % 19)), " ".join(r.choices(VOCABULARY, k=1 + i % 9))) for i in range(72)]
    docs = []
    for d in range(400):
        text = r.choice(r.choice(items)[1:])
        n = len(text.split())
        docs.append((d, f"{prose(r.randrange(0, 40), d)} {changed(text, min(n, r.randrange(0, 6)), d)} {prose(r.randrange(0, 40), d + 1)}"))
    got, want = run(spark, docs, items), brute(docs, items)
    assert got == want and len(want) > 200


def test_texts_of_few_words(spark):
    items = [(1, "Paris France", None, "SELECT 1"), (2, "what is the name of the largest customer", None, None), (3, "Oslo", "a b c", None)]
    docs = [(1, "He saw Paris, France and ran SELECT 1;"), (2, "So: what is the name of the biggest customer?"), (3, "Paris Texas, select 2"), (4, "oslo! A x C"), (5, "a x y")]
    assert run(spark, docs, items) == [(1, 1), (2, 2), (4, 3)] == brute(docs, items)


def test_repeated_items_and_copies_of_one_document(spark):
    items = [(i, ITEMS[0][1], ITEMS[0][1], None) for i in range(40)]
    docs = [(d, f"{ITEMS[0][1]} {ITEMS[0][1]}") for d in range(50)]
    assert run(spark, docs, items) == [(d, i) for d in range(50) for i in range(40)]


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    docs = [(d, f"{prose(60, d)} {ITEMS[d % 30][1 + d % 3]} {prose(60, d + 1)}") for d in range(60)]
    want = run(spark, docs)
    monkeypatch.setattr(leakage, "FILTER_BITS", 15)
    assert run(spark, docs) == want and len(want) >= 60


def test_very_long_document(spark, monkeypatch):
    monkeypatch.setattr(leakage, "STREAM", 5000)
    text = prose(20_000, 8) + " " + ITEMS[20][1] + " " + prose(4_979, 9) + " " + ITEMS[21][2]
    assert run(spark, [(1, text)]) == [(1, 20), (1, 21)]


@pytest.mark.parametrize("docs,items", [([], ITEMS), ([(1, "a b c")], [])])
def test_empty(spark, docs, items):
    assert run(spark, docs, items) == []


def test_item_without_texts(spark):
    assert run(spark, [(1, "a b c")], [(1, None, "", None)]) == []
