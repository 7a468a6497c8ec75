import itertools
import os
import random

import numpy as np
import pytest

from kolonnade.llm import mixture as M

pytestmark = pytest.mark.skipif(not os.path.exists(f"{M.TOKENIZERS}/{M.VOCABULARY}"), reason="no tokenizer files")
DS = "doc_id long, text string, source string, n_tokens int, h long"
TS = "source string, target_share double, max_repeats int, share double"


@pytest.mark.parametrize("seed", range(25))
def test_fit_counts_is_as_good_as_can_be(seed):
    r = random.Random(seed)
    lengths = np.array(sorted(r.sample(range(2, 30), r.randrange(1, 5))))
    counts = np.array([r.randrange(1, 5) for _ in lengths])
    budget = r.randrange(0, int((lengths * counts).sum()) + 3)
    best = max(t for c in itertools.product(*[range(n + 1) for n in counts]) if (t := int(np.dot(c, lengths))) <= budget)
    got = M.fit_counts(lengths, counts, budget)
    assert (got <= counts).all() and (got >= 0).all() and int(np.dot(got, lengths)) == best


def test_fit_counts_large():
    r = np.random.default_rng(2)
    lengths = np.unique(r.integers(5, 4000, 800))
    counts = r.integers(1, 400, len(lengths))
    budget = int((lengths * counts).sum() * 0.37)
    got = M.fit_counts(lengths, counts, budget)
    assert int((got * lengths).sum()) == budget and (got <= counts).all()


def run(spark, docs, targets, **more):
    chosen, report = M.mixture(spark.createDataFrame([(*d, 1, 1) for d in docs], DS), spark.createDataFrame([(*t, 0.5) for t in targets], TS), **more)
    return chosen.collect(), {r["source"]: r for r in report.collect()}


def docs():
    r = random.Random(1)
    text = lambda: " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(r.randrange(5, 60)))
    return [(i, text(), ["big_one", "Big-One", " BIG ONE"][i % 3]) for i in range(300)] + [(1000 + i, text(), "small") for i in range(20)] + [(2000 + i, text(), "other") for i in range(100)]


def test_shares_and_caps(spark):
    d = docs() + [(3000, docs()[0][1], "big one"), (3001, None, "small"), (3002, "", "small"), (None, "x", "small"), (3003, "x y z", None), (3004, "unwanted", "elsewhere")]
    chosen, report = run(spark, d + d[:3], [("big_one", 0.6, 1), ("small", 0.3, 3), ("other", 0.3, 2), ("absent", 0.2, 4), (None, 1.0, 1)])
    assert set(report) == {"big_one", "small", "other", "absent"}
    total = sum(r["used_tokens"] for r in report.values())
    for name, share in (("big_one", 0.5), ("small", 0.25), ("other", 0.25)):
        assert abs(report[name]["used_tokens"] / total - share) < 0.005
    assert report["absent"]["used_tokens"] == 0 and report["absent"]["docs"] == 0
    caps = {"bigone": 1, "small": 3, "other": 2}
    assert all(r["n_uses"] <= caps[r["source"]] for r in chosen)
    assert max(r["n_uses"] for r in chosen if r["source"] == "small") == 3
    assert not {3000, 3003, 3004} & {r["doc_id"] for r in chosen}  # a copy, and documents without a wanted source
    assert len({r["doc_id"] for r in chosen}) == len(chosen)


def test_same_seed_same_documents_and_given_total(spark):
    first, report = run(spark, docs(), [("big_one", 1.0, 1)], total=1000)
    again, _ = run(spark, list(reversed(docs())), [("big_one", 1.0, 1)], total=1000)
    assert sorted(map(tuple, first)) == sorted(map(tuple, again)) and report["big_one"]["used_tokens"] == 1000


def test_one_length_holds_all(spark):
    rows = [(i, f"word{i:05d} and the rest", "s") for i in range(3000)]
    chosen, report = run(spark, rows, [("s", 1.0, 1)], total=5001)
    n = {r["n_tokens"] for r in chosen}
    assert 5001 - max(n) < report["s"]["used_tokens"] <= 5001


def test_empty(spark):
    assert run(spark, [], [("s", 1.0, 1)])[0] == []
    assert run(spark, docs()[:5], [])[0] == []
    assert run(spark, docs()[:5], [("small", None, None), ("big_one", 0.0, 1)])[0] == []


def test_counts_are_those_of_the_tokenizer(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{M.TOKENIZERS}/{M.VOCABULARY}", "rb"))}
    enc = tiktoken.Encoding("t", pat_str=M.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello world", "Größe: 7 €\n\n  x", "ab " * 60_000]
    got = {r["doc_id"]: r["n_tokens"] for r in M.token_counts(spark.createDataFrame([(i, t, "s", 0, 0) for i, t in enumerate(texts)], DS)).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}
