"""The pipeline's stages on a small corpus, each against what a plain loop keeps, and the queries' registration."""

import random

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from tidemark.llm import simhash
from tidemark.llm.queries import oracle_sql, queries, tokenizer_path

WORDS = {"en": "the of and with that thing over some water light morning paper".split(), "de": "der die und nicht schön über straße wasser licht morgen papier fenster".split()}


def corpus():
    rng = random.Random(11)
    made = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + rng.choice("abcdefgh") + rng.choice("xyzuvw") for _ in range(n))
    items = [made("en", 24) for _ in range(3)]
    texts = [(made(lang, 80), lang) for lang in ("en", "de") * 30]
    texts += [(texts[0][0], "en"), (texts[1][0] + " zusatz", "de"), ("", "en"), (None, "de"), ("12345 !!!", "en")]
    texts += [(f"{made('en', 30)} {items[1]} {made('en', 30)}", "en"), (f"{made('en', 40)} password=Hunter2Hunter2 {made('en', 40)}", "en")]
    return [(i, t, lang, f"src{i % 3}", len(t or "")) for i, (t, lang) in enumerate(texts)], [(i, t) for i, t in enumerate(items)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, items = corpus()
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage(spark, folder):
    docs, items = corpus()
    text = {d[0]: d[1] for d in docs}
    df = spark.read.parquet(f"{folder}/documents.parquet")
    want = [i for i, t in text.items() if t and any(c.isalpha() for c in t)]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, folder).cache()
        if name == "near_dedup":
            prints = {i: [simhash.fingerprint(simhash.rehashed(simhash.shingle_hashes(text[i], 2), v)) for v in range(5)] for i in want}
            keep = []
            for i in sorted(want):  # no chains of links in this corpus
                if not any(any((a ^ b).bit_count() <= 3 for a, b in zip(prints[i], prints[j])) for j in keep):
                    keep.append(i)
            want = keep
            assert 60 not in want and 61 not in want
        elif name == "decontaminate":
            want = [i for i in want if not any(t.lower() in text[i].lower() for _, t in items)]
            assert 65 not in want
        elif name == "secrets":
            text[66] = text[66].replace("password=Hunter2Hunter2", "[secret]")
        if name == "packing":
            tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
            assert sorted((r.doc_id, r.length) for r in out.collect()) == sorted((i, len(tokenizer.encode(text[i], add_special_tokens=False).ids) + 1) for i in want)
        else:
            assert out.columns == df.columns, name
            assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted((i, text[i]) for i in want), name
        df = out


def test_run_and_registration(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() == len(corpus()[0]) - 6
    names = list(queries())
    assert [n for n in names if n.startswith("op")] == [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] and names[-1] == "pipeline"
    assert set(oracle_sql()) <= set(names) and corpus_pipeline.ORACLE_SQL is None
