"""What the ids of a corpus cost: scans of its texts, lookups of its words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import token_output
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.word_cache import WordEncoder


def test_a_dictionary_takes_two_scans_of_the_texts(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = [(i, None if i % 50 == 7 else f"text number {i} of so many words " * 9) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).withColumn("text", seen.asNondeterministic()("text"))
    assert len(token_output.train_dictionary(docs, tokenizer_path("byte_bpe_50k.json"))) > 0
    assert read.value <= 2 * len(rows)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("entries", [0, 6, 10**6])
def test_each_word_is_looked_up_once_and_new_ones_stand_in_their_places(name, entries):
    encoder = WordEncoder(tokenizer_path(name), entries)
    looked, learned = [], []

    class Counted(type(encoder.words)):
        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

    encoder.words = Counted()
    learn = encoder._learn
    encoder._learn = lambda words: learned.extend(words) or learn(words)
    texts = ["a new word and a new word, then one more.\nA new line", "", "Zwei neue Wörter, a new word", "x" * 90 + " a long one, " + "x" * 90, "two  spaces. .. <|endoftext|>"]
    for _ in range(2):
        got = encoder.encode_bytes(texts)
        want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert got == want
        assert len(looked) == sum(len(t.replace("\n", " \n").replace(".", " .").replace(",", " ,").split(" ")) for t in texts[:4] if t)
        assert len(learned) == len(set(learned))
        looked.clear(), learned.clear()
    assert all(len(w) <= 64 for w in encoder.words) and len(encoder.words) <= max(entries, 0)
