"""Three-way merges of keyed tables, cell by cell.

b, a and t are a key's base, target and source rows; equality is over whole rows, NULL equal to NULL, absent
equal to absent. In order: a = b takes t; t = b keeps a; a = t keeps a; an absent base is add_add; an absent
side is delete_modify; else each cell merges alike, and a cell that both sides changed differently conflicts.
A row with a conflict has no merged row. Presence is a flag of its own, so rows of NULLs are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import DELETE, INSERT, UPDATE, same_row
from tidemark.plans.resolve import Chain, beyond, priority, segment_filter


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, pk: list[str], values: list[str]) -> DataFrame:
    """The three states side by side: pk, __b/__a/__t presence, b_/a_/t_ values."""
    side = lambda df, p: df.select(*pk, *[F.col(v).alias(f"{p}_{v}") for v in values], F.lit(True).alias(f"__{p}"))
    j = side(base, "b").join(side(ours, "a"), pk, "full_outer").join(side(theirs, "t"), pk, "full_outer")
    return j.withColumns({f"__{p}": F.coalesce(F.col(f"__{p}"), F.lit(False)) for p in "bat"})


def three_way_scan(log: DataFrame, base: Chain, ours: Chain, theirs: Chain, pk: list[str], values: list[str]) -> DataFrame:
    """As three_way, from the log itself, for the keys of which either side shows other versions than the base.

    Two scans: one finds those keys, the other takes all three winners of each in one aggregation. So a merge moves
    what changed, not the table. Equal chains have one winner.
    """
    touched = log.where(beyond(ours, base) | beyond(theirs, base)).select(*pk).distinct()
    chains: dict[tuple, str] = {}
    names = [chains.setdefault(tuple(map(tuple, c)), f"__w{i}") for i, c in enumerate((base, ours, theirs))]
    few = log.where(segment_filter([*base, *ours, *theirs]) & F.col("session_id").isNull()).join(touched, pk, "left_semi")
    row = F.struct("op", *values)
    won = few.groupBy(*pk).agg(*[F.max_by(row, F.when(segment_filter(list(c)), F.struct((-priority(list(c))).alias("p"), "seq_from"))).alias(n) for c, n in chains.items()])
    sides = []
    for p, n in zip("bat", names):
        there = F.coalesce(F.col(n)["op"] != DELETE, F.lit(False))
        sides += [there.alias(f"__{p}"), *[F.when(there, F.col(n)[v]).alias(f"{p}_{v}") for v in values]]
    # One row to a row, but its columns are then plain ones: the optimizer would else copy their expressions into all
    # that follow, which grows without bound.
    return won.select(*pk, F.inline(F.array(F.struct(*sides))))


def judge(sides: DataFrame, pk: list[str], values: list[str]) -> DataFrame:
    """Adds kind (null where clean), present, m_ values, and cells: the columns in conflict."""
    col = F.col
    same = lambda x, y: (col(f"__{x}") == col(f"__{y}")) & same_row([col(f"{x}_{v}") for v in values], [col(f"{y}_{v}") for v in values])
    ab, tb, at = col("__ab"), col("__tb"), col("__at")
    cell: dict[str, Column] = {v: ~(col(f"a_{v}").eqNullSafe(col(f"b_{v}")) | col(f"t_{v}").eqNullSafe(col(f"b_{v}")) | col(f"a_{v}").eqNullSafe(col(f"t_{v}"))) for v in values}
    marked = sides.withColumns({"__ab": same("a", "b"), "__tb": same("t", "b"), "__at": same("a", "t")})
    clean = ab | tb | at
    cells = F.array_compact(F.array(*[F.when(c, F.lit(v)) for v, c in cell.items()])).cast("array<string>")
    kind = F.when(clean, None).when(~col("__b"), "add_add").when(~col("__a") | ~col("__t"), "delete_modify").when(F.size("cells") > 0, "cell")
    merged = {}
    for v in values:
        by_cell = F.when(col(f"a_{v}").eqNullSafe(col(f"b_{v}")), col(f"t_{v}")).otherwise(col(f"a_{v}"))
        merged[f"m_{v}"] = F.when(ab, col(f"t_{v}")).when(tb | at, col(f"a_{v}")).otherwise(by_cell)
    return marked.withColumn("cells", cells).withColumn("kind", kind).withColumn("present", F.when(ab, col("__t")).when(tb | at, col("__a")).otherwise(F.lit(True))).withColumns(merged)


def merged_rows(judged: DataFrame, pk: list[str], values: list[str]) -> DataFrame:
    """The merged state without conflicting rows."""
    return judged.where("kind is null and present").select(*pk, *[F.col(f"m_{v}").alias(v) for v in values])


def merge_changes(judged: DataFrame, pk: list[str], values: list[str]) -> DataFrame:
    """What the target must change: op and full rows."""
    same = same_row([F.col(f"m_{v}") for v in values], [F.col(f"a_{v}") for v in values])
    op = F.when(F.col("present") & ~F.col("__a"), INSERT).when(~F.col("present") & F.col("__a"), DELETE).when(F.col("present") & F.col("__a") & ~same, UPDATE)
    rows = judged.where("kind is null").withColumn("op", op).where("op is not null")
    return rows.select(*pk, "op", *[F.when(F.col("op") != DELETE, F.col(f"m_{v}")).alias(v) for v in values])


def conflicts(judged: DataFrame, pk: list[str], values: list[str]) -> DataFrame:
    """One row per conflicting cell, or per row for add_add and delete_modify, values as text."""
    text = lambda p: F.element_at(F.map_from_arrays(F.array(*[F.lit(v) for v in values]), F.array(*[F.col(f"{p}_{v}").cast("string") for v in values])), F.col("column"))
    rows = judged.where("kind is not null").withColumn("column", F.explode(F.when(F.col("kind") == "cell", F.col("cells")).otherwise(F.array(F.lit(None).cast("string")))))
    return rows.select(*pk, "kind", "column", *[F.when(F.col("column").isNotNull(), text(p)).alias(n) for p, n in (("b", "base_value"), ("a", "ours_value"), ("t", "theirs_value"))])


def resolved(judged: DataFrame, pk: list[str], values: list[str], choices: DataFrame) -> DataFrame:
    """The changes that apply recorded resolutions: choices hold pk, column (null for the row), choice, value.

    choice is ours, theirs, base or value. A row is resolved where all its conflicts are.
    """
    want = choices.groupBy(*pk).agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("column", F.lit("")).alias("k"), F.struct("choice", "value").alias("v")))).alias("pick"))
    j = judged.where("kind is not null").join(want, pk)
    names = F.when(F.col("kind") == "cell", F.col("cells")).otherwise(F.array(F.lit("")))
    j = j.where(F.forall(names, lambda c: F.array_contains(F.map_keys("pick"), c)))
    whole = F.col("pick").getItem("")["choice"]
    types = dict(judged.dtypes)

    def value(v: str) -> Column:
        one = F.col("pick").getItem(v)
        by = F.when(one["choice"] == "theirs", F.col(f"t_{v}")).when(one["choice"] == "base", F.col(f"b_{v}")).when(one["choice"] == "value", one["value"].cast(types[f"a_{v}"])).when(one["choice"] == "ours", F.col(f"a_{v}"))
        row = F.when(whole == "theirs", F.col(f"t_{v}")).when(whole == "base", F.col(f"b_{v}")).otherwise(F.col(f"a_{v}"))
        return F.when(whole.isNotNull(), row).when(F.array_contains("cells", v), by).otherwise(F.col(f"m_{v}"))

    present = F.when(whole == "theirs", F.col("__t")).when(whole == "base", F.col("__b")).when(whole.isNotNull(), F.col("__a")).otherwise(F.lit(True))
    j = j.withColumn("__p", present).withColumns({f"r_{v}": value(v) for v in values})
    same = same_row([F.col(f"r_{v}") for v in values], [F.col(f"a_{v}") for v in values])
    op = F.when(F.col("__p") & ~F.col("__a"), INSERT).when(~F.col("__p") & F.col("__a"), DELETE).when(F.col("__p") & F.col("__a") & ~same, UPDATE)
    return j.withColumn("op", op).where("op is not null").select(*pk, "op", *[F.when(F.col("op") != DELETE, F.col(f"r_{v}")).alias(v) for v in values])
