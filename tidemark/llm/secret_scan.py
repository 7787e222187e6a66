"""Secret scans with corpus-wide ownership, in DataFrame functions alone.

Candidates are the base patterns and long mixed tokens outside them. Each candidate's hash is counted over the
distinct repositories and owners of the whole corpus. One that EXAMPLE_OWNERS owners or EXAMPLE_REPOS repositories
hold is a widely copied example; one that a single owner holds, in fewer repositories than that, and that looks
random is live. A long mixed token joins the spans, as kind "owned", where it is live.

Positions are code points, end exclusive. Matches and the text between them come from one pattern each, so
starts are running sums of their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_hot, materialize, release

EXAMPLE_OWNERS, EXAMPLE_REPOS = 5, 8
#: Kinds in listed order: pattern, group of the value, least length of the value. Runs of fewer characters than the
#: least can be left out of the search for access and hex: a run that fails has no part that passes.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
)
OWNED = ("owned", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 0, 20)
_SPAN = "array<struct<start:bigint,kind:int,stop:bigint,value:string>>"
_NAMES = [k[0] for k in (*KINDS, OWNED)]
_BLOCK = 256


def _may_hold(text: Column) -> list[Column]:
    """For each of KINDS and OWNED a cheap test that every text with a match passes, whatever the match's length."""
    low = F.lower(text)
    named = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    run = text.rlike("[A-Za-z0-9+/_=-]{20}")
    return [named & (F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))), F.contains(text, F.lit("AKIA")), run, run]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(rows: Column, step, kind: str) -> Column:
    """(at, out) of a fold over rows by step(done, row), which appends to done.out; out is in blocks of _BLOCK rows.

    Appending copies, so that one long list would take the square of its length.
    """

    def block(done: Column, i: Column) -> Column:
        part = F.aggregate(F.slice(rows, i * _BLOCK + 1, _BLOCK), F.struct(done["at"].alias("at"), F.array().cast(kind).alias("out")), step)
        return _let(part, lambda p: F.struct(p["at"].alias("at"), F.concat(done["out"], F.array(p["out"]).cast(f"array<{kind}>")).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(rows) - 1, F.lit(0)) / _BLOCK).cast("int"))
    return F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out")), block)


def _spans(text: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind, leftmost and non-overlapping, without those whose value is too short."""
    hits = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))
    pairs = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.struct(F.length(gap).cast("long").alias("gap"), F.length(hit["m"]).cast("long").alias("size"), hit["v"].alias("value")))

    def step(done: Column, row: Column) -> Column:
        begin = done["at"] + row["gap"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("kind"), (begin + row["size"]).alias("stop"), row["value"].alias("value"))
        return F.struct((begin + row["size"]).alias("at"), F.concat(done["out"], F.array(span).cast(_SPAN)).alias("out"))

    # Behind the last match the zip has no partner.
    whole = _let(F.filter(pairs, lambda row: row["size"].isNotNull()), lambda rows: F.flatten(_running(rows, step, _SPAN)["out"]))
    return F.when(text.rlike(pattern), F.filter(whole, lambda s: F.length(s["value"]) >= least)).otherwise(F.array().cast(_SPAN))


def _distinct(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, "")))


def _mixed(value: Column) -> Column:
    """Ten characters or more, with digits beside capitals, or with five changes between letters and digits."""
    changes = F.size(F.regexp_extract_all(value, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]"), F.lit(0)))
    return value.rlike("[0-9]") & (value.rlike("[A-Z]") | (changes >= 5)) & (_distinct(value) >= 10)


def _random(value: Column) -> Column:
    return value.rlike("[0-9]") & (_distinct(value) >= 8)


def candidates(rows: DataFrame, text: Column, repo: Column, owner: Column, keep: list[Column]) -> DataFrame:
    """keep, repo, owner, base spans, further candidate spans and row, a number of its own, of each row; to be written at once."""
    none = F.array().cast(_SPAN)
    may = _may_hold(F.col("t"))
    base = F.array_sort(F.concat(*[F.when(may[i], _spans(F.col("t"), i, *kind[1:])).otherwise(none) for i, kind in enumerate(KINDS)]))
    free = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    more = F.when(may[-1], F.filter(_spans(F.col("t"), len(KINDS), *OWNED[1:]), lambda s: _mixed(s["value"]) & free(s))).otherwise(none)
    said = rows.select(*keep, F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(text.cast("string"), F.lit("")).alias("t"))
    found = said.withColumn("base", base).withColumn("more", more).drop("t")
    return found.withColumn("row", F.monotonically_increasing_id())


def ownership(each: DataFrame) -> DataFrame:
    """hash, owners, repos, random of every candidate value (hash, owner, repo, random), over all rows."""
    pairs = each.groupBy("hash", "owner", "repo").agg(F.max("random").alias("random"))
    return pairs.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"), F.max("random").alias("random"))


def verdicts(counts: DataFrame) -> DataFrame:
    """hash and verdict: example, live, or shared for what is neither."""
    wide = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repos") >= EXAMPLE_REPOS)
    return counts.select("hash", F.when(wide, "example").when((F.col("owners") == 1) & F.col("random"), "live").otherwise("shared").alias("verdict"))


def _hash(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def judged(found: DataFrame) -> DataFrame:
    """Per row with a candidate: the hashes of its live values and of its widely copied ones."""
    spans = found.where(F.size("base") + F.size("more") > 0).select("row", "owner", "repo", F.explode(F.array_distinct(F.transform(F.concat("base", "more"), lambda s: s["value"]))).alias("value"))
    each = materialize(spans.select("row", "owner", "repo", _hash(F.col("value")).alias("hash"), _random(F.col("value")).alias("random")), "candidates")
    known = materialize(verdicts(ownership(each)).where("verdict <> 'shared'"), "verdicts")
    pick = lambda v: F.collect_set(F.when(F.col("verdict") == v, F.col("hash")))
    # A copied example may be held by a third of all rows.
    out = materialize(join_hot(each.select("row", "hash"), known, "hash").groupBy("row").agg(pick("live").alias("live"), pick("example").alias("example")), "judged")
    release(each, known)
    return out


def _with_verdicts(found: DataFrame) -> DataFrame:
    none = F.array().cast("array<binary>")
    both = found.join(judged(found), "row", "left")
    return both.withColumns({c: F.coalesce(c, none) for c in ("live", "example")})


def _is(s: Column, verdict: str) -> Column:
    return F.array_contains(F.col(verdict), _hash(s["value"]))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", repo: str = "repo", owner: str = "owner") -> DataFrame:
    """One row per row of docs: doc_id, base and all spans (start, kind, stop, value), live and example hashes.

    Null text counts as empty, a null repository or owner as one without a name. Rows are told apart by a number of
    their own, so null and repeated ids lose nothing. Other columns are ignored, whatever their names.
    """
    found = materialize(candidates(docs, F.col(text), F.col(repo), F.col(owner), [F.col(id_col).alias("doc_id")]), "secrets")
    some = F.size("base") + F.size("more") > 0
    none = F.array().cast("array<binary>")
    plain = found.where(~some).select("doc_id", "base", F.col("base").alias("spans"), none.alias("live"), none.alias("example"))
    spans = F.array_sort(F.concat("base", F.filter("more", lambda s: _is(s, "live"))))
    return plain.unionByName(_with_verdicts(found.where(some)).select("doc_id", "base", spans.alias("spans"), "live", "example"))


def _digest(spans: Column) -> Column:
    names = F.array(*[F.lit(n) for n in _NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", repo: str = "repo", owner: str = "owner") -> DataFrame:
    """doc_id, counts by base kind, base_sha256, spans, and how many spans are live or widely copied, of every row.

    A row without a span has the hash and the list of nothing. Ties of a start are in the order of KINDS. No rows
    give no rows; for nulls and repeated ids see scan.
    """
    rows = scan(docs, id_col, text, repo, owner)
    n = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    among = lambda c: F.size(F.filter("spans", lambda s: _is(s, c))).cast("long")
    return rows.select(
        "doc_id", *[n(i).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)], F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"), among("live").alias("n_live"), among("example").alias("n_example")
    )


def redact(docs: DataFrame, mark: str = "[secret]", text: str = "text", repo: Column | str = "source", owner: Column | str = "source") -> DataFrame:
    """docs with every span that is no widely copied example replaced by mark; all rows and columns stay.

    Overlapping spans are replaced together. The replaced text is rebuilt from the whole text; n_chars follows it
    where there is such a column. Each row has its own spans, whatever its id; null text stays null; the columns of
    docs travel as one value, so none clashes with another name.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    may = _may_hold(F.coalesce(F.col(text).cast("string"), F.lit("")))
    maybe = may[0] | may[1] | may[2]
    found = materialize(candidates(docs.where(maybe), F.col(text), col(repo), col(owner), [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")]), "secrets")
    t = F.coalesce(F.col("doc")[text].cast("string"), F.lit(""))
    cuts = F.array_sort(F.concat(F.filter("base", lambda s: ~_is(s, "example")), F.filter("more", lambda s: _is(s, "live"))))

    def step(done: Column, s: Column) -> Column:
        gap = F.array(F.struct(done["at"].alias("a"), (s["start"] - done["at"]).alias("n")))
        return F.struct(F.greatest(done["at"], s["stop"]).alias("at"), F.when(s["start"] >= done["at"], F.concat(done["out"], gap)).otherwise(done["out"]).alias("out"))

    def pieces(block: Column) -> Column:
        # A piece is found from the start of its block, not of the whole text.
        first, last = block[0]["a"], F.element_at(block, -1)
        part = F.substring(F.col("t"), (first + 1).cast("int"), (last["a"] + last["n"] - first).cast("int"))
        return _let(part, lambda p: F.transform(block, lambda g: F.substring(p, (g["a"] - first + 1).cast("int"), g["n"].cast("int"))))

    rows = _with_verdicts(found).withColumn("cuts", cuts).select("doc", t.alias("t"), _running(F.col("cuts"), step, "array<struct<a:bigint,n:bigint>>").alias("done"))
    blocks = F.filter("done.out", lambda b: F.size(b) > 0)
    tail = F.substring(F.col("t"), (F.col("done.at") + 1).cast("int"), F.length("t"))
    clean = F.array_join(F.concat(F.flatten(F.transform(blocks, pieces)), F.array(tail)), mark)
    cut = F.size(blocks) > 0
    new = {text: F.when(cut, clean).otherwise(F.col("doc")[text])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length(clean)).otherwise(F.col("doc")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return docs.where(~maybe).unionByName(rows.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns]))
