"""Assignments whose sign stands far from the name."""

import hashlib

from tidemark.llm import secret_scan


def test_padded_assignments_are_found_and_redacted(spark):
    texts = ["secret" + " " * n + '= "abcdefgh12345678" end' for n in (0, 98, 99, 100, 120, 400, 5000)] + ["API_KEY'" + " " * 300 + ":" + " " * 300 + "abcdefgh12345678"]
    texts = [t.replace("abcdefgh", f"abcdef{i:02}") for i, t in enumerate(texts)]  # a value that many owners hold is an example
    docs = spark.createDataFrame([(i, t, f"src{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secret_scan.report(docs, repo="source", owner="source").collect()}
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    for i, t in enumerate(texts):
        stop = t.index("12345678") + 8
        assert got[i].n_assign == 1 and got[i].base_sha256 == hashlib.sha256(f"assign:0:{stop}".encode()).hexdigest(), i
        assert "12345678" not in clean[i], i
