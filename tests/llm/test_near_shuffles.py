"""What the near-copy stage shuffles: whole texts once a join, and of long open texts no square of their length."""

import random
import time

from tests.llm.test_near_copies import edited, similarity
from tidemark.llm import simhash


def shuffled(spark) -> int:
    """Bytes of shuffles written so far."""
    spark.range(8).repartition(2).count()
    time.sleep(0.5)
    spark.range(1).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_kept_texts_are_dealt_out_once(spark, monkeypatch):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "other words"), (None, "no id at all"), (None, "no id at all"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_one(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(kept.collect(), key=str) == sorted([(1, rows[0][1]), (1, rows[2][1]), (None, rows[3][1]), (2, None)], key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 2


def test_long_open_texts_shuffle_no_square_of_their_length(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    texts = [" ".join(edited(rng, base, rng.choice((30, 40, 50)))) for _ in range(40)]
    least = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if least[a] != least[b] and similarity(texts[a], texts[b]) >= 0.8:
                lo, hi = sorted((least[a], least[b]))
                least = [lo if x == hi else x for x in least]
    assert 1 < len(set(least)) < 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = shuffled(spark)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(least))
    wrote = shuffled(spark) - before
    print("shuffled", wrote, "texts", sum(map(len, texts)), "groups", len(set(least)))
    assert wrote < 25 * sum(map(len, texts))


def test_few_pairs_found_lead_to_all_at_once():
    assert simhash.next_share(1 / 256, 12, 7537) == 1.0
    assert simhash.next_share(1 / 256, 7537, 7537) == simhash.STEP / 256
    assert simhash.next_share(1.0, 5, 10) == 1.0
