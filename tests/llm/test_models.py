"""Models against their definitions: the dual optimum, count ratios, the fast pass, templates by plain loops, recall."""

import math
import os
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, quality, simhash

DATA = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")


def test_count_ratios_by_hand():
    rows, labels = [np.array([0, 1]), np.array([1]), np.array([2, 1])], np.array([1, 0, 1])
    ratio = quality.log_count_ratio(rows, labels, 4)
    p, q = [2, 3, 2, 1], [1, 2, 1, 1]
    assert np.allclose(ratio, [math.log((a / sum(p)) / (b / sum(q))) for a, b in zip(p, q)])


def test_descent_reaches_the_optimum():
    """At the optimum of the dual no single variable can move, and both objectives are equal."""
    rng = np.random.default_rng(2)
    n, d = 60, 12
    x = rng.standard_normal((n, d)) * (rng.random((n, d)) < 0.6)
    x[:, -1] = 1
    y = np.where(x @ rng.standard_normal(d) + rng.standard_normal(n) > 0, 1.0, -1.0)
    rows, cost = [np.flatnonzero(v) for v in x], rng.uniform(0.3, 2, n)
    w, alpha = quality._descend(rows, [v[r] for v, r in zip(x, rows)], y, cost, 3000, 1, d)
    assert np.allclose(w, (alpha * y) @ x) and ((alpha >= 0) & (alpha <= cost)).all()
    margin = y * (x @ w)
    assert (margin[alpha < 1e-9] > 1 - 1e-3).all() and (margin[alpha > cost - 1e-9] < 1 + 1e-3).all()
    assert np.allclose(margin[(alpha > 1e-6) & (alpha < cost - 1e-6)], 1, atol=1e-3)
    primal, dual = 0.5 * w @ w + (cost * np.maximum(0, 1 - margin)).sum(), alpha.sum() - 0.5 * w @ w
    assert abs(primal - dual) < 1e-3 * primal


def test_fast_pass_equals_training_pass():
    network = language_id.Network(["a", "b", "c"], hidden=5, seed=3)
    rng = np.random.default_rng(1)
    for lengths in ([16, 16, 16], [16, 9, 1, 7]):
        data = rng.integers(1, 256, (len(lengths), 16), dtype=np.uint8)
        for i, n in enumerate(lengths):
            data[i, n:] = 0
        got = network.pooled(data, np.array(lengths))
        for i, n in enumerate(lengths):
            one = data[i : i + 1, :n].T
            hf, hb = (np.stack([s[5] for s in network._run(k, v)]) for k, v in (("f", one), ("b", one[::-1])))
            logits = hf @ network.w["of"] + hb[::-1] @ network.w["ob"] + network.w["bias"]
            assert np.allclose(got[i], language_id._softmax(logits).sum(axis=(0, 1)), atol=1e-4)


def test_letters():
    assert [language_id.has_letter(t) for t in (None, "", "²½Ⅷ①_9", "²ñ", "日", "1a", "́")] == [False, False, False, True, True, True, False]


def brute_template(text):
    t = (text or "").translate(str.maketrans("<>:_", "    "))
    number = decontaminate._NUMBER
    t = regex.sub(decontaminate._NAME, lambda m: f"<name:{m[0]}>", t).lower()
    t = regex.sub(number, lambda m: f"<num:{m[1] or ''}_{m[2] or ''}{m[3] or ''}{m[4] or ''}> <unit:{m[5] or ''}>", t)
    t = regex.sub(r"[^\p{L}\p{N}<>:_%]+", " ", t).strip(" ")
    return regex.sub("(<num:[^>]*)> <unit:>(?: and)?(?: <num:([^>]*)> <unit:>)+", lambda m: f"{m[1]}_{m[2]}> <unit:>", t).split(" ")


def brute_windows(words, width):
    out = []
    for i in range(len(words) - width + 1):
        w = words[i : i + width]
        slots = [x for x in w if x.startswith("<")]
        out.append((i, tuple(x.split(":")[0] if x.startswith("<") else x for x in w) if len(slots) <= width - decontaminate.PLAIN else ("valued", *w), slots))
    return out


def brute_contaminated(docs, items, least=0.5):
    found = set()
    for i, text in docs:
        words = brute_template(text)
        for item, asked in items:
            a = brute_template(asked) if asked is not None else []
            width = decontaminate.WIDTH if len(a) >= 2 * decontaminate.WIDTH - 1 else decontaminate.SHORT
            mine = {}
            for pos, key, slots in brute_windows(a, width):
                mine.setdefault(key, (pos, slots))
            hits = [(p - mine[k][0], mine[k][0], list(zip(mine[k][1], s))) for p, k, s in brute_windows(words, width) if k in mine]
            if not mine or len({h[1] for h in hits}) < least * len(mine):
                continue
            shift = max({h[0] for h in hits}, key=lambda s: (len({h[1] for h in hits if h[0] == s}), s))
            values = {}
            for s, _, pairs in hits:
                if s == shift:
                    for x, y in pairs:
                        values.setdefault(x, set()).add(y)
            if all(len(v) == 1 for v in values.values()):
                found.add((i, item, round(len({h[1] for h in hits}) / len(mine), 9), all(v == {x} for x, v in values.items())))
    return found


def test_contamination_against_plain_loops(spark):
    rng = random.Random(12)
    vocabulary = "has and gives of the to walks home apples pears rope then who with them all is for on".split()
    names, numbers, units = ["Alice", "Bob", "Zork", "maria", "Klaus"], ["7", "12", "3.5", "twelve", "twenty one", "90"], ["km", "kg", "", "hours", ""]

    def made(n):
        out = []
        for _ in range(n):
            k = rng.random()
            out.append(rng.choice(names) if k < 0.12 else f"{rng.choice(numbers)} {rng.choice(units)}".strip() if k < 0.27 else rng.choice(vocabulary))
        return " ".join(out) + rng.choice([".", "?", ""])

    items = [(i, made(rng.choice([3, 4, 6, 8, 12, 20, 30]))) for i in range(40)] + [(40, None), (41, ""), (42, "two words"), (43, "1 2 3 4 5 6 7 8 9 10"), (44, "Bob")]
    items.append((45, items[5][1]))
    docs = []
    for i in range(120):
        text = made(rng.randint(0, 40))
        if i % 2:
            asked = rng.choice(items[:40])[1]
            for _ in range(rng.randrange(3)):
                a, b = rng.choice([(names, names), (numbers, numbers), (vocabulary, vocabulary)])
                asked = asked.replace(rng.choice(a), rng.choice(b), rng.choice([1, -1]))
            text = f"{text} {asked} {made(rng.randint(0, 20))}"
        docs.append((i, text))
    docs += [(200, "1 2 3 9 9 4 1 10"), (201, ""), (202, "so two words"), (203, items[5][1].upper())]
    want = brute_contaminated(docs, items)
    got = decontaminate.contaminated(spark.createDataFrame([*docs, (300, None), (None, items[7][1]), (5, docs[5][1])], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, round(r.coverage, 9), r.same) for r in got if r.doc_id is not None} == want
    assert len(want) > 40 and any(not w[3] for w in want) and any(w[2] < 1 for w in want)
    assert (None, 7) in {(r.doc_id, r.item_id) for r in got} and len(got) == len(want) + sum(r.doc_id is None for r in got) + sum(w[0] == 5 for w in want)


def test_many_windows_go_in_slices(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(30)], "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("say "), "text").alias("text"))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 50)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == {(i, i) for i in range(30)}
    assert decontaminate.clean(docs, items).count() == 0


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_every_near_copy_of_the_test_table_is_found_and_nothing_else_goes(spark):
    """All pairs by a plain inverted index: recall of near copies other than exact ones, and of exact ones, is whole."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    first = {}
    for i in sorted(text):
        first.setdefault(shingles(text[i]), i)
    sets, index, top = {i: s for s, i in first.items()}, {}, {i: i for i in first.values()}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    near = 0
    for i, s in sets.items():
        common = {}
        for x in s:
            for j in index.setdefault(x, []):
                common[j] = common.get(j, 0) + 1
            index[x].append(i)
        for j, n in common.items():
            if n / (len(s) + len(sets[j]) - n) >= 0.8:
                near += 1
                a, b = sorted((root(i), root(j)))
                top[b] = a
    kept = {r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()}
    assert kept == {i for i in sets if root(i) == i} and near > 0
