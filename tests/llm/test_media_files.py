"""Media tables take as many files as their rows need, whatever the partitions."""

import glob

from tidemark.llm import media_chunks


def test_few_rows_take_few_files(spark, monkeypatch):
    written = []

    def counted(df, name, *args, put=media_chunks.materialize, **more):
        out = put(df, name, *args, **more)
        written.append(len(glob.glob(f"{out.scratch.removeprefix('file:')}/part-*")))
        return out

    monkeypatch.setattr(media_chunks, "materialize", counted)
    texts = [" ".join(f"word{i * j % 97}" for j in range(600 + i)) for i in range(120)] * 2 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(30)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("24", "false")):
            spark.conf.set(k, v)
        got = {r.doc_id: r for r in media_chunks.media_columns(docs).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(got) == len(texts) and all(got[i].media_sha256 == got[i + 120].media_sha256 for i in range(120))
    assert [got[i].n_bytes for i in range(len(texts))] == [len(t or "") for t in texts]
    assert sum(written) <= 4
