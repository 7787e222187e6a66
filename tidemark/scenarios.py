"""One registered query per operator over the test tables, each with its SQL.

``part`` is a tracked table with two branches over it, ``events`` a change log of its users (seq is the
microsecond of the event, an error is a tombstone), ``conversations`` a table with a composite key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import encoding, values
from tidemark.functions.expressions import Arith, Case, Coalesce, Concat, Const, Ref
from tidemark.functions.predicates import And, Col, In, Not, Or
from tidemark.operators import changes, history, merge, privacy, retention
from tidemark.plans.resolve import as_of, candidate_resolve, intervals, resolve, winners
from tidemark.sources import connect, export

PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
IDS = dict(enumerate(PART, 1))
PK = ["p_partkey"]
VALUES = PART[1:]
MAIN, B1, B2 = ("main", 0), ("b1", 1), ("b2", 1)
CHAIN1, CHAIN2 = [B1, MAIN], [B2, B1, MAIN]
USERS = ["user_id"]
T1, T2 = "2024-01-10 00:00:00", "2024-01-19 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _versions(df: DataFrame, branch: str, seq: int, op, session: str | None = None) -> DataFrame:
    return df.select(F.lit(branch).alias("branch_id"), F.lit(seq).cast("long").alias("seq_from"), (F.lit(op) if isinstance(op, int) else op).cast("int").alias("op"), F.lit(session).cast("string").alias("session_id"), *df.columns)


def part_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part on main; b1 reprices every 7th and deletes every 10th; b2, forked from b1, rebrands every 5th."""
    p = table(spark, sf_dir, "part").select(*PART)
    gone = F.col("p_partkey") % 10 == 0
    first = p.where(gone | (F.col("p_partkey") % 7 == 0))
    first = first.select("p_partkey", *[F.when(~gone, F.col(c) * 1.08 if c == "p_retailprice" else F.col(c)).alias(c) for c in VALUES])
    second = p.where((F.col("p_partkey") % 5 == 0) & (F.col("p_partkey") % 3 != 0)).withColumn("p_brand", F.lit("Brand#99"))
    return _versions(p, "main", 0, 1).unionByName(_versions(first, "b1", 1, F.when(gone, 3).otherwise(2))).unionByName(_versions(second, "b2", 1, 2))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("main").alias("branch_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq_from"), F.when(F.col("event_type") == "error", 3).otherwise(2).alias("op"), F.lit(None).cast("string").alias("session_id"), "user_id", "event_type", "value", "event_id")


def micros(text: str) -> int:
    from datetime import datetime, timezone

    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000


_BASE = "SELECT 2 AS prio, 1 AS op, p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"
_FIRST = """SELECT 1 AS prio, CASE WHEN p_partkey % 10 = 0 THEN 3 ELSE 2 END AS op, p_partkey, p_name, p_brand, p_type, p_size, p_retailprice * 1.08::DOUBLE AS p_retailprice FROM part WHERE p_partkey % 10 = 0 OR p_partkey % 7 = 0"""
_SECOND = "SELECT 0 AS prio, 2 AS op, p_partkey, p_name, 'Brand#99' AS p_brand, p_type, p_size, p_retailprice FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 3 <> 0"
_PICK = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY prio) AS rn FROM ({arms})) WHERE rn = 1"
_B1 = f"SELECT {', '.join(PART)} FROM ({_PICK.format(arms=_BASE + ' UNION ALL ' + _FIRST)}) WHERE op <> 3"
_B2 = f"SELECT {', '.join(PART)} FROM ({_PICK.format(arms=_BASE + ' UNION ALL ' + _FIRST + ' UNION ALL ' + _SECOND)}) WHERE op <> 3"
_LOG = "SELECT user_id, epoch_us(ts) AS seq_from, CASE WHEN event_type = 'error' THEN 3 ELSE 2 END AS op, event_type, value, event_id FROM events"


def _state(moment: str) -> str:
    return f"SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq_from DESC) AS rn FROM ({_LOG}) WHERE seq_from <= {micros(moment)}) WHERE rn = 1 AND op <> 3"


# Resolution


@query(_B1)
def resolve_branch(spark, sf_dir):
    return resolve(part_log(spark, sf_dir), CHAIN1, PK)


@query(_B2)
def resolve_depth3(spark, sf_dir):
    return resolve(part_log(spark, sf_dir), CHAIN2, PK)


@query(f"SELECT p_partkey, op, prio FROM ({_PICK.format(arms=_BASE + ' UNION ALL ' + _FIRST)}) WHERE op = 3")
def tombstone_mask(spark, sf_dir):
    return winners(part_log(spark, sf_dir), CHAIN1, PK).where("op = 3").select("p_partkey", "op", (F.col("__prio") + 1).alias("prio"))


@query(f"SELECT * FROM ({_B2}) WHERE p_brand = 'Brand#99' AND p_retailprice > 950")
def filtered_read(spark, sf_dir):
    return resolve(part_log(spark, sf_dir), CHAIN2, PK, where=And([Col("p_brand") == "Brand#99", Col("p_retailprice") > 950.0]))


@query(f"SELECT * FROM ({_B2}) WHERE p_brand = 'Brand#99'")
def candidate_two_pass(spark, sf_dir):
    return candidate_resolve(part_log(spark, sf_dir), CHAIN2, PK, Col("p_brand") == "Brand#99")


@query(f"SELECT * FROM ({_B1}) WHERE p_partkey = 77")
def key_read(spark, sf_dir):
    return resolve(part_log(spark, sf_dir), CHAIN1, PK, where=Col("p_partkey") == 77)


@query(f"SELECT * FROM ({_B1}) WHERE p_name LIKE '%e%r%' AND p_type LIKE '%E%'")
def like_filter(spark, sf_dir):
    return resolve(part_log(spark, sf_dir), CHAIN1, PK, where=Col("p_name").like("%e%r%") & Col("p_type").like("%E%"))


@query(f"SELECT * FROM ({_B1}) WHERE p_size IN (1, 5, 9)")
def in_filter(spark, sf_dir):
    return resolve(part_log(spark, sf_dir), CHAIN1, PK, where=In("p_size", (1, 5, 9)))


@query(f"SELECT * FROM ({_B1}) WHERE false")
def empty_in_filter(spark, sf_dir):
    return resolve(part_log(spark, sf_dir), CHAIN1, PK, where=In("p_size", ()))


@query(f"SELECT * FROM ({_B1}) WHERE NOT (p_size < 10 OR p_size >= 40) AND p_brand <> 'Brand#11'")
def boolean_filter(spark, sf_dir):
    return resolve(part_log(spark, sf_dir), CHAIN1, PK, where=And([Not(Or([Col("p_size") < 10, Col("p_size") >= 40])), Col("p_brand") != "Brand#11"]))


_STAGED = "SELECT -1 AS prio, CASE WHEN p_partkey % 4 = 0 THEN 3 ELSE 2 END AS op, p_partkey, p_name, p_brand, p_type, p_size + 100 AS p_size, p_retailprice FROM part WHERE p_partkey % 6 = 0"


@query(f"SELECT {', '.join(PART)} FROM ({_PICK.format(arms=_BASE + ' UNION ALL ' + _FIRST + ' UNION ALL ' + _STAGED)}) WHERE op <> 3")
def session_overlay(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(*PART)
    staged = p.where("p_partkey % 6 = 0").withColumn("p_size", F.col("p_size") + 100)
    log = part_log(spark, sf_dir).unionByName(_versions(staged, "b1", 1, F.when(F.col("p_partkey") % 4 == 0, 3).otherwise(2), "s1"))
    log = log.unionByName(_versions(staged.withColumn("p_size", F.lit(-1)), "b1", 1, 2, "other"))
    return resolve(log, CHAIN1, PK, session="s1")


@query(_state(T1))
def at_commit(spark, sf_dir):
    return resolve(events_log(spark, sf_dir), [("main", micros(T1))], USERS)


_DAYS = "SELECT DISTINCT date_trunc('day', ts) AS day FROM events"


@query(f"SELECT 'main' AS branch_id, epoch_us(day) AS moment, (SELECT max(epoch_us(e.ts)) FROM events e WHERE e.ts <= d.day AND e.event_type = 'purchase') AS seq FROM ({_DAYS}) d")
def as_of_time(spark, sf_dir):
    """Purchases stand for commits, midnights for moments."""
    e = table(spark, sf_dir, "events").withColumn("moment", F.unix_micros(F.col("ts").cast("timestamp")))
    commits = e.where("event_type = 'purchase'").select(F.lit("main").alias("branch_id"), "moment", F.col("moment").alias("seq"))
    days = e.select(F.lit("main").alias("branch_id"), (F.floor(F.col("moment") / 86_400_000_000) * 86_400_000_000).alias("moment")).distinct()
    return as_of(commits, days)


@query("SELECT branch_id, moment, max(seq) AS seq FROM (SELECT 'main' AS branch_id, n_nationkey AS moment FROM nation) m LEFT JOIN (SELECT r_regionkey * 5 AS seq FROM region) c ON c.seq <= m.moment GROUP BY branch_id, moment")
def as_of_many(spark, sf_dir):
    """Many moments at once, over spans that hold a few commits each."""
    commits = table(spark, sf_dir, "region").select(F.lit("main").alias("branch_id"), (F.col("r_regionkey") * 5).cast("long").alias("moment"), (F.col("r_regionkey") * 5).cast("long").alias("seq"))
    return as_of(commits, table(spark, sf_dir, "nation").select(F.lit("main").alias("branch_id"), F.col("n_nationkey").cast("long").alias("moment")), 8)


@query(_B1)
def append_only_resolve(spark, sf_dir):
    """Three versions of each key on one branch: the newest alone shows."""
    log = part_log(spark, sf_dir)
    older = log.where("branch_id = 'b1'").withColumn("seq_from", F.lit(0).cast("long")).withColumn("p_brand", F.lit("old"))
    return resolve(log.unionByName(older), CHAIN1, PK)


# History


@query(f"SELECT user_id, seq_from, lead(seq_from, 1, 9223372036854775807) OVER (PARTITION BY user_id ORDER BY seq_from) AS seq_to, op, event_id FROM ({_LOG})")
def version_intervals(spark, sf_dir):
    return intervals(events_log(spark, sf_dir), USERS).select("user_id", "seq_from", "seq_to", "op", "event_id")


_BLAME = """
SELECT user_id, 'event_type' AS "column", min(seq_from) AS seq_from, arg_min(event_type, seq_from) AS value FROM (
  SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY seq_from DESC) AS run FROM (
    SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0
      WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR op = 3 OR lag(op) OVER w = 3 THEN 1 ELSE 0 END AS brk
    FROM ({log}) WINDOW w AS (PARTITION BY user_id ORDER BY seq_from DESC)))
WHERE run = 0 GROUP BY user_id
"""


@query(_BLAME.format(log=_LOG))
def blame(spark, sf_dir):
    return history.blame(events_log(spark, sf_dir), USERS, ["event_type"])


_DIFF = """SELECT user_id, CASE WHEN b.u IS NULL THEN 1 WHEN a.u IS NULL THEN 3 ELSE 2 END AS op, old_event_type, new_event_type, old_event_id, new_event_id FROM
 (SELECT user_id, user_id AS u, event_type AS old_event_type, event_id AS old_event_id FROM ({x})) b FULL JOIN
 (SELECT user_id, user_id AS u, event_type AS new_event_type, event_id AS new_event_id FROM ({y})) a USING (user_id)
 WHERE b.u IS NULL OR a.u IS NULL OR old_event_type IS DISTINCT FROM new_event_type OR old_event_id IS DISTINCT FROM new_event_id""".format(x=_state(T1), y=_state(T2))


@query(_DIFF)
def diff_range(spark, sf_dir):
    log = events_log(spark, sf_dir).drop("value")
    d = history.diff(log, [("main", micros(T2))], micros(T1), micros(T2), USERS, {1: "user_id", 2: "event_type", 3: "event_id"})
    return d.select("user_id", "op", "old_event_type", "new_event_type", "old_event_id", "new_event_id")


@query(f"SELECT op, count(*) AS n FROM ({_DIFF}) GROUP BY op")
def diff_counts(spark, sf_dir):
    return history.diff_counts(diff_range(spark, sf_dir))


_SNAP = f"""SELECT p_partkey, CASE WHEN b.k IS NULL THEN 1 WHEN a.k IS NULL THEN 3 ELSE 2 END AS op, old_brand, new_brand, old_price, new_price FROM
 (SELECT p_partkey, p_partkey AS k, p_brand AS old_brand, p_retailprice AS old_price FROM part) b FULL JOIN
 (SELECT p_partkey, p_partkey AS k, p_brand AS new_brand, p_retailprice AS new_price FROM ({_B2})) a USING (p_partkey)
 WHERE b.k IS NULL OR a.k IS NULL OR old_brand <> new_brand OR old_price <> new_price"""


@query(_SNAP)
def snapshot_diff(spark, sf_dir):
    log = part_log(spark, sf_dir)
    d = history.compare(resolve(log, [MAIN], PK), resolve(log, CHAIN2, PK), PK, IDS)
    return d.select("p_partkey", "op", *[F.col(f"{p}_{c}").alias(f"{p}_{n}") for c, n in (("p_brand", "brand"), ("p_retailprice", "price")) for p in ("old", "new")])


@query(f"SELECT p_partkey, list_filter([CASE WHEN old_brand IS DISTINCT FROM new_brand THEN 3 END, CASE WHEN old_price IS DISTINCT FROM new_price THEN 6 END], lambda x: x IS NOT NULL)::VARCHAR AS changed FROM ({_SNAP}) WHERE op = 2")
def changed_columns(spark, sf_dir):
    log = part_log(spark, sf_dir)
    d = history.compare(resolve(log, [MAIN], PK), resolve(log, CHAIN2, PK), PK, IDS).where("op = 2")
    return d.select("p_partkey", F.concat(F.lit("["), F.array_join(F.col("changed").cast("array<string>"), ", "), F.lit("]")).alias("changed"))


@query(f"SELECT user_id, CASE op WHEN 1 THEN 3 WHEN 3 THEN 1 ELSE 2 END AS op, old_event_type AS event_type, old_event_id AS event_id FROM ({_DIFF})")
def revert(spark, sf_dir):
    log = events_log(spark, sf_dir).drop("value")
    columns = {1: "user_id", 2: "event_type", 3: "event_id"}
    return history.inverse(history.diff(log, [("main", micros(T2))], micros(T1), micros(T2), USERS, columns), USERS, columns)


@query(f"SELECT DISTINCT user_id FROM ({_DIFF}) WHERE user_id IN (SELECT user_id FROM events WHERE epoch_us(ts) > {micros(T2)})")
def revert_blockers(spark, sf_dir):
    return history.touched_later(events_log(spark, sf_dir), "main", micros(T2), diff_range(spark, sf_dir), USERS)


# Merge

_OURS = """SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN 'ours' ELSE p_brand END AS p_brand, p_type, CASE WHEN p_partkey % 15 = 0 THEN p_size + 1 ELSE p_size END AS p_size, p_retailprice FROM part WHERE p_partkey % 26 <> 0
 UNION ALL SELECT -1, 'new', 'a', 't', 1, 1.0 UNION ALL SELECT -2, 'only ours', 'a', 't', 1, 1.0"""
_THEIRS = """SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_partkey % 15 = 0 THEN p_size + 2 ELSE p_size END AS p_size, CASE WHEN p_partkey % 4 = 0 THEN p_retailprice + 5 ELSE p_retailprice END AS p_retailprice FROM part WHERE p_partkey % 22 <> 0
 UNION ALL SELECT -1, 'new', 'b', 't', 1, 1.0 UNION ALL SELECT -3, 'only theirs', 'b', 't', 1, 1.0"""


def _eq(x: str, y: str) -> str:
    return f"(({x}.k IS NULL) = ({y}.k IS NULL) AND " + " AND ".join(f"{x}.{c} IS NOT DISTINCT FROM {y}.{c}" for c in VALUES) + ")"


_CELL = " OR ".join(f"(a.{c} IS DISTINCT FROM b.{c} AND t.{c} IS DISTINCT FROM b.{c} AND a.{c} IS DISTINCT FROM t.{c})" for c in VALUES)
_SIDES = f"""SELECT coalesce(b.k, a.k, t.k) AS p_partkey, b.k AS bk, a.k AS ak, t.k AS tk,
 CASE WHEN {_eq('a', 'b')} OR {_eq('t', 'b')} OR {_eq('a', 't')} THEN NULL WHEN b.k IS NULL THEN 'add_add' WHEN a.k IS NULL OR t.k IS NULL THEN 'delete_modify' WHEN {_CELL} THEN 'cell' END AS kind,
 CASE WHEN {_eq('a', 'b')} THEN t.k IS NOT NULL WHEN {_eq('t', 'b')} OR {_eq('a', 't')} THEN a.k IS NOT NULL ELSE true END AS present,
 {', '.join(f"CASE WHEN {_eq('a', 'b')} THEN t.{c} WHEN {_eq('t', 'b')} OR {_eq('a', 't')} THEN a.{c} WHEN a.{c} IS NOT DISTINCT FROM b.{c} THEN t.{c} ELSE a.{c} END AS {c}" for c in VALUES)},
 {', '.join(f"{p}.{c} AS {p}_{c}" for p in 'bat' for c in VALUES)}
 FROM (SELECT *, p_partkey AS k FROM part) b FULL JOIN (SELECT *, p_partkey AS k FROM ({_OURS})) a ON a.k = b.k FULL JOIN (SELECT *, p_partkey AS k FROM ({_THEIRS})) t ON t.k = coalesce(b.k, a.k)"""


def merge_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(*PART)
    k = F.col("p_partkey")
    ours = p.where(k % 26 != 0).withColumn("p_brand", F.when(k % 3 == 0, "ours").otherwise(F.col("p_brand"))).withColumn("p_size", F.when(k % 15 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    theirs = p.where(k % 22 != 0).withColumn("p_retailprice", F.when(k % 4 == 0, F.col("p_retailprice") + 5).otherwise(F.col("p_retailprice"))).withColumn("p_size", F.when(k % 15 == 0, F.col("p_size") + 2).otherwise(F.col("p_size")))
    ours = ours.unionByName(spark.createDataFrame([(-1, "new", "a", "t", 1, 1.0), (-2, "only ours", "a", "t", 1, 1.0)], p.schema))
    theirs = theirs.unionByName(spark.createDataFrame([(-1, "new", "b", "t", 1, 1.0), (-3, "only theirs", "b", "t", 1, 1.0)], p.schema))
    return merge.judge(merge.three_way(p, ours, theirs, PK, VALUES), PK, VALUES)


@query(f"SELECT {', '.join(PART)} FROM ({_SIDES}) WHERE kind IS NULL AND present")
def merge_rows(spark, sf_dir):
    return merge.merged_rows(merge_sides(spark, sf_dir), PK, VALUES)


@query(f"""SELECT p_partkey, op, {', '.join(f'CASE WHEN op <> 3 THEN {c} END AS {c}' for c in VALUES)} FROM (SELECT *, CASE WHEN present AND ak IS NULL THEN 1 WHEN NOT present AND ak IS NOT NULL THEN 3
 WHEN present AND ak IS NOT NULL AND ({' OR '.join(f'{c} IS DISTINCT FROM a_{c}' for c in VALUES)}) THEN 2 END AS op FROM ({_SIDES}) WHERE kind IS NULL) WHERE op IS NOT NULL""")
def merge_changes(spark, sf_dir):
    return merge.merge_changes(merge_sides(spark, sf_dir), PK, VALUES)


@query(f"""SELECT p_partkey, kind, CASE WHEN kind = 'cell' THEN 'p_size' END AS "column", CASE WHEN kind = 'cell' THEN b_p_size::VARCHAR END AS base_value, CASE WHEN kind = 'cell' THEN a_p_size::VARCHAR END AS ours_value, CASE WHEN kind = 'cell' THEN t_p_size::VARCHAR END AS theirs_value FROM ({_SIDES}) WHERE kind IS NOT NULL""")
def merge_conflicts(spark, sf_dir):
    return merge.conflicts(merge_sides(spark, sf_dir), PK, VALUES)


@query(f"SELECT p_partkey, 2 AS op, t_p_size AS p_size, p_brand FROM ({_SIDES}) WHERE kind = 'cell'")
def merge_resolutions(spark, sf_dir):
    sides = merge_sides(spark, sf_dir)
    choices = merge.conflicts(sides, PK, VALUES).where("kind = 'cell'").select("p_partkey", "column", F.lit("theirs").alias("choice"), F.lit(None).cast("string").alias("value"))
    return merge.resolved(sides, PK, VALUES, choices).select("p_partkey", "op", "p_size", "p_brand")


@query(f"""SELECT p_partkey, op, p_brand, p_retailprice FROM (SELECT x.p_partkey, x.p_brand, x.p_retailprice, CASE WHEN x.p_partkey IS NOT NULL AND (x.p_brand <> p.p_brand OR x.p_retailprice <> p.p_retailprice) THEN 2 END AS op FROM ({_B2}) x JOIN part p USING (p_partkey)
 UNION ALL SELECT p_partkey, NULL, NULL, 3 FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM ({_B2}))) WHERE op IS NOT NULL""")
def merge_from_log(spark, sf_dir):
    """b2 merged into main, against main, from the log."""
    sides = merge.three_way_scan(part_log(spark, sf_dir), [MAIN], [MAIN], CHAIN2, PK, VALUES)
    return merge.merge_changes(merge.judge(sides, PK, VALUES), PK, VALUES).select("p_partkey", "op", "p_brand", "p_retailprice")


# Changes and expressions


@query("""SELECT p_partkey, op, CASE WHEN op <> 3 THEN p_brand END AS p_brand, n_changed FROM (
 SELECT p_partkey, 'x' AS p_brand, 1 AS op, 5 AS n_changed FROM (SELECT -p_partkey AS p_partkey FROM part WHERE p_partkey % 50 = 0 AND p_partkey > 0)
 UNION ALL SELECT p_partkey, p_brand || '!', 2, 1 FROM part WHERE p_partkey % 50 = 1
 UNION ALL SELECT p_partkey, NULL, 3, 5 FROM part WHERE p_partkey % 50 = 3)""")
def commit_changes(spark, sf_dir):
    """Inserts, updates, writes of equal rows, deletes, and deletes of absent keys, as one commit stores them."""
    p = table(spark, sf_dir, "part").select(*PART)
    part = lambda r: p.where(F.col("p_partkey") % 50 == r)
    asked = part(0).where("p_partkey > 0").withColumn("p_partkey", -F.col("p_partkey")).withColumn("p_brand", F.lit("x")).withColumn("op", F.lit(2))
    asked = asked.unionByName(part(1).withColumn("p_brand", F.concat("p_brand", F.lit("!"))).withColumn("op", F.lit(1))).unionByName(part(2).withColumn("op", F.lit(2)))
    asked = asked.unionByName(part(3).withColumn("op", F.lit(3))).unionByName(part(4).withColumn("p_partkey", -F.col("p_partkey")).withColumn("op", F.lit(3)))
    return changes.normalise(asked, p, PK, IDS).select("p_partkey", "op", "p_brand", F.size("changed").alias("n_changed"))


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size * 2 AS p_size, p_retailprice FROM part WHERE p_brand LIKE 'Brand#1%' AND p_size <> 0")
def update_where(spark, sf_dir):
    return changes.update_where(table(spark, sf_dir, "part").select(*PART), Col("p_brand").like("Brand#1%"), {"p_size": Arith("*", Ref("p_size"), Const(2))})


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND turn >= 2")
def delete_where(spark, sf_dir):
    return changes.delete_where(table(spark, sf_dir, "conversations"), And([Col("role") == "user", Col("turn") >= 2]), ["conv_id", "turn"])


@query("""SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size IN (20, 30) THEN 'round' ELSE p_type END AS p_name, coalesce(NULL, p_brand) AS p_brand, p_brand || '-' || p_size AS p_type, (p_partkey - 7) // 2 * 1 + 3 AS p_size FROM part WHERE p_partkey > 7""")
def assignments(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey > 7").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    new = {
        "p_name": Case(((Col("p_size") <= 10, Const("small")), (In("p_size", (20, 30)), Const("round"))), Ref("p_type")), "p_brand": Coalesce((Const(None), Ref("p_brand"))), "p_type": Concat((Ref("p_brand"), Const("-"), Ref("p_size"))),
        "p_size": Arith("+", Arith("/", Arith("-", Ref("p_partkey"), Const(7)), Const(2)), Const(3)),
    }
    from tidemark.functions.expressions import assigned

    return p.select("p_partkey", *[assigned(e, p.schema, n).alias(n) for n, e in new.items()])


@query("SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12,2)) * 1.08 AS DECIMAL(16,4))::DOUBLE AS price, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 100 // (p_size % 5) END AS share FROM part")
def exact_arithmetic(spark, sf_dir):
    from decimal import Decimal

    from tidemark.functions.expressions import compile_expression

    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(12,2)").alias("price"), (F.col("p_size") % 5).alias("fifth"))
    price = compile_expression(Arith("*", Ref("price"), Const(Decimal("1.08"))), p.schema)
    share = compile_expression(Arith("/", Const(100), Ref("fifth")), p.schema)
    return p.select("p_partkey", price.column.cast("decimal(16,4)").cast("double").alias("price"), share.column.alias("share"))


@query("SELECT p_partkey, CASE WHEN x LIKE '%.%' THEN rtrim(rtrim(x, '0'), '.') ELSE x END AS price FROM (SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS x FROM part)")
def decimal_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", values.decimal_text(F.col("p_retailprice").cast("decimal(12,2)")).alias("price"))


# Validation


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n_rows, min(c_custkey) AS first_key FROM customer GROUP BY c_mktsegment, c_nationkey HAVING count(*) > 1")
def validate_unique(spark, sf_dir):
    v = changes.unique_violations(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], ["c_custkey"])
    return v.select("c_mktsegment", "c_nationkey", "n_rows", F.col("first_key.c_custkey").alias("first_key"))


@query("""SELECT 'c_name' AS "column", count(*) AS n_rows FROM customer WHERE c_custkey % 9 = 0 HAVING count(*) > 0""")
def validate_not_null(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("c_name", F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")))
    return changes.null_violations(c, ["c_name", "c_nationkey"])


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0)")
def validate_foreign(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0")
    return changes.foreign_violations(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), ["l_orderkey"], o, ["o_orderkey"])


# Retention and checks


@query("""SELECT count(*) FILTER (b IS NULL) AS live_only, count(*) FILTER (a IS NULL) AS version_only, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND pa <> pb) AS mismatched FROM
 (SELECT o_orderkey AS a, o_totalprice AS pa FROM orders WHERE o_orderkey % 11 <> 0) x FULL JOIN (SELECT o_orderkey AS b, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS pb FROM orders WHERE o_orderkey % 17 <> 0) y ON a = b""")
def drift(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    stored = o.where("o_orderkey % 17 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return retention.drift(o.where("o_orderkey % 11 <> 0"), stored, ["o_orderkey"], ["o_totalprice"])


_PRUNE = f"SELECT *, seq_to <= {micros(T2)} AS old, row_number() OVER (PARTITION BY user_id ORDER BY seq_from) AS rn FROM (SELECT *, lead(seq_from, 1, 9223372036854775807) OVER (PARTITION BY user_id ORDER BY seq_from) AS seq_to FROM ({_LOG}))"


@query(f"SELECT user_id, seq_from, op, event_id FROM ({_PRUNE}) WHERE NOT old OR rn = 1")
def prune(spark, sf_dir):
    return retention.prune(events_log(spark, sf_dir), "main", micros(T2), USERS).select("user_id", "seq_from", "op", "event_id")


@query(f"SELECT user_id, count(*) - 1 AS removed, min(seq_from) AS seq_from, max(seq_to) AS seq_to FROM ({_PRUNE}) WHERE old GROUP BY user_id HAVING count(*) > 1")
def prune_report(spark, sf_dir):
    return retention.prune_report(events_log(spark, sf_dir), "main", micros(T2), USERS)


@query("SELECT CASE WHEN branch = 'b1' THEN 1 ELSE 0 END AS prio, p_partkey, op FROM (SELECT 'main' AS branch, p_partkey, 1 AS op FROM part UNION ALL SELECT 'b1', p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 3 ELSE 2 END FROM part WHERE p_partkey % 10 = 0 OR p_partkey % 7 = 0)")
def collect_garbage(spark, sf_dir):
    kept = retention.collect_garbage(part_log(spark, sf_dir), spark.createDataFrame([("main",), ("b1",)], "branch_id string"))
    return kept.select(F.when(F.col("branch_id") == "b1", 1).otherwise(0).alias("prio"), "p_partkey", "op")


@query(f"SELECT user_id, seq_from, op FROM ({_LOG}) WHERE user_id % 4 <> 0")
def purge(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return retention.purge(log, log.where("user_id % 4 = 0").select("user_id"), USERS).select("user_id", "seq_from", "op")


_BROKEN = f"SELECT user_id, seq_from, CASE WHEN event_id % 101 = 0 THEN seq_to + 5 WHEN event_id % 103 = 0 AND seq_to < 9223372036854775807 THEN seq_to - 5 WHEN event_id % 107 = 0 THEN 9223372036854775807 ELSE seq_to END AS seq_to FROM (SELECT *, lead(seq_from, 1, 9223372036854775800) OVER (PARTITION BY user_id ORDER BY seq_from) AS seq_to FROM ({_LOG}))"


@query(f"SELECT user_id, seq_from, fault FROM (SELECT *, CASE WHEN seq_to = 9223372036854775807 THEN 'open' WHEN nxt < seq_to THEN 'overlap' WHEN nxt > seq_to THEN 'gap' END AS fault FROM (SELECT *, lead(seq_from) OVER (PARTITION BY user_id ORDER BY seq_from, seq_to) AS nxt FROM ({_BROKEN})) WHERE nxt IS NOT NULL) WHERE fault IS NOT NULL")
def verify_intervals(spark, sf_dir):
    log = events_log(spark, sf_dir)
    nxt = F.lead("seq_from", 1, 9223372036854775800).over(W.partitionBy("user_id").orderBy("seq_from"))
    e = F.col("event_id")
    stored = log.withColumn("seq_to", nxt).withColumn("seq_to", F.when(e % 101 == 0, F.col("seq_to") + 5).when((e % 103 == 0) & (F.col("seq_to") < values.MAX_SEQ), F.col("seq_to") - 5).when(e % 107 == 0, values.MAX_SEQ).otherwise(F.col("seq_to")))
    return retention.interval_faults(stored, USERS).select("user_id", "seq_from", "fault")


@query("SELECT user_id, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY user_id HAVING count(*) > 1")
def open_versions(spark, sf_dir):
    stored = events_log(spark, sf_dir).withColumn("seq_to", F.when(F.col("event_id") % 3 == 0, values.MAX_SEQ).otherwise(F.col("seq_from") + 1))
    return retention.open_versions(stored, USERS).select("user_id", "n")


# Paging, logs, sinks


@query(f"SELECT * FROM ({_B1}) WHERE p_partkey > 100 ORDER BY p_partkey LIMIT 50")
def page_after(spark, sf_dir):
    return resolve(part_log(spark, sf_dir), CHAIN1, PK, after={"p_partkey": 100}, limit=50)


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id > 7 OR (conv_id = 7 AND turn > 1) ORDER BY conv_id, turn LIMIT 20")
def page_after_composite(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return resolve(_versions(c, "main", 0, 1), [MAIN], ["conv_id", "turn"], after={"conv_id": 7, "turn": 1}, limit=20)


@query("SELECT id, name, type, kind FROM (VALUES (1, 'n_nationkey', 'int', 2), (2, 'n_name', 'string', 5), (3, 'n_regionkey', 'int', 2)) v(id, name, type, kind)")
def introspect(spark, sf_dir):
    rows = connect.introspect(connect.open_table(spark, f"{sf_dir}/nation.parquet"))
    return spark.createDataFrame([(r["id"], r["name"], r["type"], r["kind"]) for r in rows], "id int, name string, type string, kind int")


@query("""SELECT n_nationkey, lower(sha256(unhex('00' || printf('%016x', 7) || printf('%08x', 4 + 9) || '00000001' || '02' || printf('%016x', n_nationkey) || '01' || '00000008' || printf('%016x', 12)
 || '00000003' || '0000000102' || printf('%016x', n_nationkey) || '0000000205' || printf('%08x', octet_length(encode(n_name))) || hex(encode(n_name)) || '0000000302' || printf('%016x', n_regionkey)))) AS leaf FROM nation""")
def leaf_digest(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    row = [(i, F.col(f.name), f.dataType) for i, f in enumerate(n.schema.fields, 1)]
    leaf = encoding.leaf_digest(7, F.lit(1), F.array(F.lit(2), F.lit(3)), [row[0][1:]], row)
    return n.select("n_nationkey", F.lower(F.hex(leaf)).alias("leaf"))


@query("SELECT n_nationkey, n_name AS opened, 'tidemark:enc:v1:' AS prefix FROM nation")
def seal_and_open(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = F.unhex(F.md5(F.col("n_regionkey").cast("string")))
    aad = privacy.associated("nation", F.col("n_nationkey").cast("string"), 2)
    sealed = n.withColumn("sealed", privacy.seal(F.col("n_name"), key, aad))
    return sealed.select("n_nationkey", privacy.unseal(F.col("sealed"), key, aad).alias("opened"), F.substring("sealed", 1, 16).alias("prefix"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN '<erased>' ELSE n_name END AS opened FROM nation")
def erased_subjects(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = F.unhex(F.md5(F.col("n_regionkey").cast("string")))
    aad = privacy.associated("nation", F.col("n_nationkey").cast("string"), 2)
    sealed = n.withColumn("sealed", privacy.seal(F.col("n_name"), key, aad))
    return sealed.select("n_nationkey", privacy.unseal(F.col("sealed"), F.when(F.col("n_regionkey") != 2, key), aad).alias("opened"))


@query("SELECT 0 AS part, count(*) AS n FROM region WHERE r_regionkey = 0 UNION ALL SELECT 1, 3 UNION ALL SELECT 2, count(*) FROM region UNION ALL SELECT 3, count(*) FROM nation")
def export_records(spark, sf_dir):
    n = _versions(table(spark, sf_dir, "nation"), "main", 0, 1)
    columns = introspect(spark, sf_dir).select("id", "name", "type")
    return export.records({"table": "nation"}, columns, table(spark, sf_dir, "region"), n, ["n_nationkey", "n_name"]).groupBy("part").agg(F.count("*").alias("n"))


@query(f"SELECT p_brand, count(*) AS n_lines, sum(l_quantity) AS quantity FROM ({_B2}) p JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand")
def materialized_join(spark, sf_dir):
    resolve(part_log(spark, sf_dir), CHAIN2, PK).createOrReplaceTempView("b2_part")
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("b2_lineitem")
    return spark.sql("SELECT p_brand, count(*) AS n_lines, sum(l_quantity) AS quantity FROM b2_part JOIN b2_lineitem ON l_partkey = p_partkey GROUP BY p_brand")


@query(f"SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM (SELECT * FROM orders WHERE o_orderkey % 9 <> 0) JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment, o_orderstatus")
def materialized_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    log = _versions(o, "main", 0, 1).unionByName(_versions(o.where("o_orderkey % 9 = 0"), "b1", 1, 3))
    live = resolve(log, CHAIN1, ["o_orderkey"])
    return live.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))
