"""A large group of texts that are mostly just too far apart: no pair is lost, and few are compared."""

import random

import pytest

from tests.llm.test_near_copies import edited, similarity
from tidemark.llm import simhash


@pytest.mark.parametrize("meetings", [64, 0.5])
def test_a_group_takes_few_comparisons_and_loses_no_link(spark, monkeypatch, meetings):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(edited(rng, base, rng.choice((2, 3, 3, 3)))) for _ in range(240)]
    least = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if least[a] != least[b] and similarity(texts[a], texts[b]) >= 0.8:
                lo, hi = sorted((least[a], least[b]))
                least = [lo if x == hi else x for x in least]
    assert 20 < len(set(least)) < 220
    compared = []

    def counted(pairs, sets, name, judge=simhash.verified):
        if name == "similar-later":
            compared.append(pairs.count())
        return judge(pairs, sets, name)

    monkeypatch.setattr(simhash, "verified", counted)
    monkeypatch.setattr(simhash, "MEETINGS", meetings, raising=False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(least))
    assert sum(compared) <= 2 * len(texts)
    assert meetings > 1 or len(compared) > 1


def test_sketches_never_promise_less_than_two_sets_share():
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    for n in (10, 150, 3000):
        a, b = simhash._set_of(" ".join(base[:n])), simhash._set_of(" ".join(edited(rng, base[:n], n // 10)))
        apart = sum((int(x) ^ int(y)).bit_count() for x, y in zip(simhash.sketch_of(a).view("<u8"), simhash.sketch_of(b).view("<u8")))
        assert 0 < apart <= len(set(a.tolist()) ^ set(b.tolist()))
