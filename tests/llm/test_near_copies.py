"""Near copies of the pipeline against exact similarities of all pairs."""

import random

from tidemark.llm import simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randrange(10**6)}"
    return out


def linked(a, b):
    prints = [[simhash.fingerprint(simhash.rehashed(simhash.shingle_hashes(t, 2), v)) for v in range(5)] for t in (a, b)]
    return any((x ^ y).bit_count() <= 3 for x, y in zip(*prints))


def test_a_link_of_fingerprints_alone_drops_nothing(spark):
    rng = random.Random(3)
    texts = []
    while len(texts) < 8:
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        a, b = " ".join(base), " ".join(edited(rng, base, 12))
        if linked(a, b) and similarity(a, b) < 0.8:
            texts += [a, b]
    texts += [texts[0] + " tail", texts[3].upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == list(range(8))


def test_near_copies_that_no_fingerprint_links_are_found(spark):
    rng = random.Random(8)
    texts = []
    while len(texts) < 40:
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        a, b = " ".join(base), " ".join(edited(rng, base, 6))
        if not linked(a, b) and similarity(a, b) >= 0.8:
            texts += [a, b]
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    chain = [base]
    for _ in range(6):  # each is near the one before, the last is far from the first
        chain.append(edited(rng, chain[-1], 8))
    chain = [" ".join(c) for c in chain]
    assert all(similarity(a, b) >= 0.8 for a, b in zip(chain, chain[1:])) and similarity(chain[0], chain[-1]) < 0.5
    docs = spark.createDataFrame(list(enumerate(texts + chain)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [*range(0, 40, 2), 40]
