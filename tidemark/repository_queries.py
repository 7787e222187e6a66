"""Registered queries over a real repository, written once per session in the shared folder, each with its SQL.

The script below makes branches, merges, sessions, proposals, schema changes, a failing commit, sealed columns and a
range of history that is dropped. Commit ids are random, so results name commits by their messages.
"""

from __future__ import annotations

import re
import tempfile
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import access, metrics
from tidemark.functions import encoding, values
from tidemark.functions.expressions import Arith, Const, Ref, compile_expression
from tidemark.functions.predicates import And, Col, In
from tidemark.operators import changes, ddl
from tidemark.operators import schema as sc
from tidemark.repository import Refused, Repository
from tidemark.scenarios import PART, query, table

SECRET = b"a key that is kept elsewhere"
_BUILT: dict[tuple[str, str], Shop] = {}


class Clock:
    """A second later each time it is asked."""

    def __init__(self) -> None:
        self.now = 1_700_000_000_000_000

    def __call__(self) -> int:
        self.now += 1_000_000
        return self.now


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode a temporary one where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tidemark-repository-")


class Shop:
    """The repository and what its script noted on the way."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        path = f"{folder(spark)}/repository-{encoding.hashlib.sha256(sf_dir.encode()).hexdigest()[:12]}-{spark.sparkContext.applicationId}-{id(self)}"
        self.repo = r = Repository.create(spark, path, "shop", "ada", Clock(), wrapping_key=bytes(range(32)))
        self.at: dict[str, str] = {}
        self.noted: dict[str, list[tuple]] = {}
        part, nation = table(spark, sf_dir, "part").select(*PART), table(spark, sf_dir, "nation")
        r.track("part", part, ["p_partkey"], unique=[["p_partkey", "p_name"]])
        r.track("nation", nation, ["n_nationkey"], unique=[["n_name"]])
        r.track("region", table(spark, sf_dir, "region"), ["r_regionkey"])
        r.untrack("region")
        r.track("people", table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), ["c_custkey"])
        self.put("resize", r.update_where("part", Col("p_size") <= 10, {"p_size": Arith("+", Ref("p_size"), Const(100))}, author="ada", message="resize"))
        r.branch("sale")
        self.put("sale", r.update_where("part", And([Col("p_brand") == "Brand#11", Col("p_size") < 40]), {"p_name": Const("sale")}, branch="sale", author="bob", message="sale"))
        self.put("sell out", r.delete_where("part", And([Col("p_size") >= 40, Col("p_size") <= 44]), author="ada", message="sell out"))
        r.tag("v1", "main")
        before = [(c.name, c.type, c.nullable) for c in r.schema("part").columns]
        r.alter_schema("part", "sale", [*before, ("margin", "int", True)], "bob")
        self.put("margin", r.commit("part", r.read("part", "sale", where=Col("p_size") == 20).withColumn("margin", F.lit(7)), "sale", "bob", "margin"))
        self.session = r.open_session("sale", "eve")
        r.session_write(self.session, "part", r.read("part", "sale", where=Col("p_size") == 30).withColumn("p_name", F.lit("staged")))
        self.note("merge base before", r.merge_base("sale", "main"))
        number = r.propose("sale", "main", "Sale", "bob")
        for who, kind in (("ada", "request_changes"), ("ada", "approve"), ("eve", "approve")):
            r.review(number, kind, who)
        plan = r.merge_schema("part", "sale", "main", number)["plan"]
        self.statements = r.plan_ddl(plan)
        r.apply_plan(plan)
        self.refused("large", lambda: r.merge("part", "sale", "main", "ada", limit=0))
        self.preview = r.merge("part", "sale", "main", apply=False).changes
        merged = r.merge_proposal(number, "part", "ada", chunked=True)  # part may be of any size
        self.at["merged"] = merged.commit
        r.branch("dev")
        self.put("dev", r.update_where("part", Col("p_size") == 25, {"p_name": Const("dev")}, branch="dev", author="bob", message="dev"))
        self.put("fix", r.update_where("part", Col("p_size") == 26, {"p_name": Const("fix")}, author="ada", message="fix"))
        self.at["updated"] = r.update_from_parent("part", "dev", "bob").commit
        whole, r._change_digest = r._change_digest, self._breaks
        for size in (28, 29):
            self.refused("broken", lambda size=size: r.update_where("part", Col("p_size") == size, {"p_name": Const("lost")}, author="ada", message="lost"), RuntimeError)
        r._change_digest = whole
        self.put("after", r.update_where("part", Col("p_size") == 27, {"p_name": Const("after")}, author="ada", message="after"))
        r.branch("names")
        renamed = [sc.Column(c.id, "title" if c.name == "p_name" else c.name, c.type, c.nullable) for c in r.schema("part").columns]
        r.alter_schema("part", "names", [(c.name, c.type, c.nullable, c.id) for c in renamed], "bob")
        self.nation(spark, nation)
        first = r.state["branches"]["main"]["head"]
        r.designate_pii("people", "c_name", "c_custkey")
        self.at["known"] = first
        r.erase_subject("people", "7", "ada", "asked")
        self.refused("children", lambda: r.delete_branch("main"))
        r.set_write_mode("nation", "guarded")
        live = r.read("nation").withColumn("n_name", F.when(F.col("n_nationkey").between(4, 6), F.lit("x")).otherwise(F.col("n_name")))
        self.refused("guarded", lambda: r.capture("nation", live))
        r.set_write_mode("nation", "capture")
        self.drift = r.capture("nation", live, "eve")

    def nation(self, spark: SparkSession, nation: DataFrame) -> None:
        """Four commits of which the first two are dropped; a tag stands on the first of all, and one key is deleted within."""
        r = self.repo
        r.tag("before", "main")
        low = r.state["branches"]["main"]["seq"] + 1
        for i, name in enumerate(("one", "two", "three", "four")):
            rows = nation.where(F.col("n_nationkey") % 4 >= i).withColumn("n_regionkey", F.lit(10 + i)).withColumn("op", F.when(F.col("n_nationkey") == i, 3).otherwise(2))
            self.put(name, r.commit("nation", rows, author="ada", message=name))
        states = lambda: [sorted(map(tuple, r.read("nation", **w).collect())) for w in ({}, {"at": "before"}, {"branch": "dev"}, {"branch": "sale"})]
        kept, old = states(), r.log("nation").count()
        r.compact("nation")
        gone = r.drop_history("nation", "main", low, low + 2)
        self.noted["dropped"] = [("states", states() == kept), ("versions", old - r.log("nation").count() == gone and gone > 0)]
        self.refused("dropped", lambda: r.read("nation", at=self.at["one"]), KeyError)

    def put(self, name: str, result) -> None:
        self.at[name] = result.commit

    def note(self, name: str, commits: list[str]) -> None:
        self.noted[name] = [(self.repo.state["commits"][c]["message"],) for c in commits]

    def refused(self, name: str, call, kind: type = Refused) -> None:
        try:
            call()
        except kind:
            self.noted.setdefault("refused", []).append((name,))

    @staticmethod
    def _breaks(*args) -> bytes:
        raise RuntimeError("broken")


def shop(spark: SparkSession, sf_dir: str) -> Shop:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = Shop(spark, sf_dir)
    return _BUILT[key]


_RESIZED = "SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_size <= 10 THEN p_size + 100 ELSE p_size END AS p_size, p_retailprice FROM part"
_SOLD = f"SELECT * FROM ({_RESIZED}) WHERE p_size NOT BETWEEN 40 AND 44"
_SALE = f"SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' AND p_size < 40 THEN 'sale' ELSE p_name END AS p_name, p_brand, p_type, p_size, p_retailprice, CASE WHEN p_size = 20 THEN 7 END AS margin FROM ({_RESIZED})"
_MERGED = f"SELECT * FROM ({_SALE}) WHERE p_size NOT BETWEEN 40 AND 44"


def _named(state: str, *pairs: tuple[int, str]) -> str:
    cases = " ".join(f"WHEN p_size = {size} THEN '{name}'" for size, name in pairs)
    return f"SELECT p_partkey, CASE {cases} ELSE p_name END AS p_name, p_brand, p_type, p_size, p_retailprice, margin FROM ({state})"


_MAIN = _named(_MERGED, (26, "fix"), (27, "after"))


@query("SELECT * FROM (VALUES ('nation', 'versioned', 2, 3), ('part', 'versioned', 1, 6), ('people', 'versioned', 3, 3)) v(\"table\", mode, table_id, columns)")
def tracked_tables(spark, sf_dir):
    return shop(spark, sf_dir).repo.tables()


@query("SELECT 1 AS op, count(*) AS n, 0 AS changed FROM part")
def backfilled(spark, sf_dir):
    r = shop(spark, sf_dir).repo
    log = r.log("part", [(r.state["branches"]["main"]["id"], 0)])
    return log.groupBy("op").agg(F.count("*").alias("n"), F.max(F.size("changed")).alias("changed"))


@query("SELECT 'nation' AS name, 'n_name' AS columns UNION ALL SELECT 'part', 'p_partkey,p_name'")
def declared_unique(spark, sf_dir):
    tables = shop(spark, sf_dir).repo.state["tables"]
    return spark.createDataFrame([(n, ",".join(u)) for n, t in tables.items() for u in t["unique"]], "name string, columns string")


@query(f"SELECT p_name, count(*) AS n_lines, sum(l_quantity) AS quantity FROM ({_SALE}) JOIN lineitem ON l_partkey = p_partkey GROUP BY p_name")
def materialized_branch(spark, sf_dir):
    shop(spark, sf_dir).repo.materialize("sale", "shop_")
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("shop_lineitem")
    return spark.sql("SELECT p_name, count(*) AS n_lines, sum(l_quantity) AS quantity FROM shop_part JOIN shop_lineitem ON l_partkey = p_partkey GROUP BY p_name")


@query(f"SELECT * FROM ({_MAIN}) WHERE p_brand LIKE 'Brand#1%' AND p_partkey > 20 ORDER BY p_partkey LIMIT 40")
def repository_read(spark, sf_dir):
    return shop(spark, sf_dir).repo.read("part", where=Col("p_brand").like("Brand#1%"), after={"p_partkey": 20}, limit=40)


@query(_SOLD)
def read_at_tag(spark, sf_dir):
    return shop(spark, sf_dir).repo.read("part", at="v1")


@query(_RESIZED)
def read_as_of(spark, sf_dir):
    s = shop(spark, sf_dir)
    return s.repo.read("part", as_of=s.repo.state["commits"][s.at["resize"]]["at"])


@query(f"SELECT * FROM ({_MAIN}) ORDER BY p_partkey LIMIT 1")
def get_row(spark, sf_dir):
    r = shop(spark, sf_dir).repo
    first = r.read("part", limit=1).first().p_partkey
    row = r.get("part", {"p_partkey": first})
    return spark.createDataFrame([tuple(row.values())], r.read("part").schema)


@query("SELECT * FROM (VALUES (0, 'dev', 2), (1, 'main', 5)) v(pos, name, seq)")
def chain_lookup(spark, sf_dir):
    r = shop(spark, sf_dir).repo
    names = {b["id"]: n for n, b in r.state["branches"].items()}
    return spark.createDataFrame([(i, names[b], q) for i, (b, q) in enumerate(r._chain("dev", None, None))], "pos int, name string, seq int")


@query(f"SELECT p_partkey FROM ({_MAIN}) WHERE margin IS NULL AND p_size IN (20, 21)")
def is_null_filter(spark, sf_dir):
    return shop(spark, sf_dir).repo.read("part", where=And([Col("margin").is_null(), In("p_size", (20, 21))])).select("p_partkey")


@query(f"SELECT p_partkey, p_name AS title, p_size FROM ({_MAIN})")
def live_names(spark, sf_dir):
    """Stored columns have ids; a renamed one is read under its new name, in files from before too."""
    return shop(spark, sf_dir).repo.read("part", "names").select("p_partkey", "title", "p_size")


@query("""SELECT state, unnest(CASE WHEN state = 'v1' THEN ['p_brand', 'p_name', 'p_partkey', 'p_retailprice', 'p_size', 'p_type'] WHEN state = 'names' THEN ['margin', 'p_brand', 'p_partkey', 'p_retailprice', 'p_size', 'p_type', 'title'] ELSE ['margin', 'p_brand', 'p_name', 'p_partkey', 'p_retailprice', 'p_size', 'p_type'] END) AS "column" FROM (VALUES ('v1'), ('main'), ('sale'), ('names')) v(state)""")
def schema_epoch_projection(spark, sf_dir):
    """Columns by state: one that came later is absent from an older state, not NULL in it."""
    r = shop(spark, sf_dir).repo
    states = {"v1": r.read("part", at="v1"), "main": r.read("part"), "sale": r.read("part", "sale"), "names": r.read("part", "names")}
    return spark.createDataFrame([(n, c) for n, df in states.items() for c in df.columns], "state string, column string")


@query(f"""SELECT p_partkey, list_filter([CASE WHEN p_size BETWEEN 26 AND 27 OR (p_brand = 'Brand#11' AND p_size < 40) THEN 2 END, CASE WHEN p_size > 100 THEN 5 END, CASE WHEN p_size = 20 THEN 7 END], lambda x: x IS NOT NULL)::VARCHAR AS mask, p_size > 100 AS touches
 FROM (SELECT p_partkey, p_brand, p_size FROM ({_RESIZED})) WHERE p_size > 100 OR p_size = 20 OR p_size BETWEEN 26 AND 27 OR (p_brand = 'Brand#11' AND p_size < 40)""")
def mask_union(spark, sf_dir):
    """Columns that updates changed on main, united per key; and whether they touch p_size."""
    r = shop(spark, sf_dir).repo
    main = r.state["branches"]["main"]["id"]
    log = r.log("part").where((F.col("branch_id") == main) & (F.col("op") == 2))
    united = log.groupBy("p_partkey").agg(values.mask_union(F.col("changed")).alias("mask"))
    return united.select("p_partkey", F.concat(F.lit("["), F.array_join(F.col("mask").cast("array<string>"), ", "), F.lit("]")).alias("mask"), values.mask_intersects(F.col("mask"), F.array(F.lit(5))).alias("touches"))


@query("SELECT * FROM (VALUES ('branch', 'main', NULL, NULL), ('branch', 'sale', 'main', true), ('branch', 'dev', 'main', true), ('branch', 'names', 'main', true), ('tag', 'v1', NULL, NULL), ('tag', 'before', NULL, NULL)) v(kind, name, parent, parent_is_ahead)")
def refs_with_parents(spark, sf_dir):
    r = shop(spark, sf_dir).repo
    heads = {n: b["head"] for n, b in r.state["branches"].items()}
    return r.refs_with_parents().select("kind", "name", "parent", (F.col("parent_head") == heads["main"]).alias("parent_is_ahead"))


@query(f"""SELECT p_partkey, 0 AS seq_from, 1 AS op, 'main' AS author FROM part WHERE p_partkey % 9 = 0 UNION ALL SELECT p_partkey, 1, 2, 'ada' FROM part WHERE p_partkey % 9 = 0 AND p_size <= 10 UNION ALL SELECT p_partkey, 2, 3, 'ada' FROM ({_RESIZED}) WHERE p_partkey % 9 = 0 AND p_size BETWEEN 40 AND 44
 UNION ALL SELECT p_partkey, 4, 2, 'ada' FROM ({_MERGED}) WHERE p_partkey % 9 = 0 AND (p_name = 'sale' OR margin = 7) UNION ALL SELECT p_partkey, 5, 2, 'ada' FROM ({_MERGED}) WHERE p_partkey % 9 = 0 AND p_size = 26 UNION ALL SELECT p_partkey, 6, 2, 'ada' FROM ({_MERGED}) WHERE p_partkey % 9 = 0 AND p_size = 27""")
def history_of_keys(spark, sf_dir):
    """All versions of many keys with the authors of their commits; the backfill is the root commit's."""
    r = shop(spark, sf_dir).repo
    keys = table(spark, sf_dir, "part").where("p_partkey % 9 = 0").select("p_partkey")
    seen = r.history("part", "main", keys)
    return seen.select("p_partkey", "seq_from", "op", F.when(F.col("message") == "root", "main").otherwise(F.col("author")).alias("author"))


@query("SELECT * FROM (VALUES (0, 11, 'Erase subject: asked'), (1, 10, 'four'), (2, 9, 'three'), (3, 8, 'two'), (4, 7, 'one')) v(pos, seq, message)")
def log_newest(spark, sf_dir):
    r = shop(spark, sf_dir).repo
    rows = r.history_log("main", 5).collect()
    return spark.createDataFrame([(i, c.seq, c.message) for i, c in enumerate(rows)], "pos int, seq int, message string")


@query("SELECT * FROM (VALUES ('before', 'resize'), ('after', 'margin')) v(moment, message)")
def merge_base(spark, sf_dir):
    s = shop(spark, sf_dir)
    now = [s.repo.state["commits"][c]["message"] for c in s.repo.merge_base("sale", "main")]
    return spark.createDataFrame([("before", m) for (m,) in s.noted["merge base before"]] + [("after", m) for m in now], "moment string, message string")


@query(f"SELECT p_partkey, CASE WHEN p_size BETWEEN 40 AND 44 THEN 1 ELSE 2 END AS op FROM ({_SALE}) WHERE p_size BETWEEN 40 AND 44 OR p_name = 'sale' OR margin = 7")
def diff_branches(spark, sf_dir):
    return shop(spark, sf_dir).repo.diff_commits("part", "v1", "sale").select("p_partkey", "op")


@query(_named(_MERGED, (25, "dev"), (26, "fix")))
def updated_from_parent(spark, sf_dir):
    return shop(spark, sf_dir).repo.read("part", "dev")


@query("SELECT * FROM (VALUES ('large', 1), ('broken', 2), ('dropped', 1), ('children', 1), ('guarded', 1)) v(name, n)")
def refusals(spark, sf_dir):
    return spark.createDataFrame(shop(spark, sf_dir).noted["refused"], "name string").groupBy("name").agg(F.count("*").cast("int").alias("n"))


@query(_MAIN)
def commit_after_failure(spark, sf_dir):
    """Commits that fail behind their write leave nothing, neither at once nor with the next commit."""
    return shop(spark, sf_dir).repo.read("part")


@query(_named(_SALE, (30, "staged")))
def session_view(spark, sf_dir):
    s = shop(spark, sf_dir)
    return s.repo.read("part", session=s.session)


@query("SELECT 1 AS proposal, 'sale' AS source, 'main' AS target, 'Sale' AS title, 'bob' AS author, 'merged' AS state, 3 AS reviews")
def proposals(spark, sf_dir):
    return shop(spark, sf_dir).repo.proposals()


@query("SELECT 'bad' AS kind, 0 AS n UNION ALL SELECT 'thinned', 2 UNION ALL SELECT 'purged', 0")
def integrity(spark, sf_dir):
    """Commits whose digests do not follow from their rows: none. Commits of dropped history are told apart."""
    r = shop(spark, sf_dir).repo
    states = [c["integrity"] for c in r.state["commits"].values()]
    return spark.createDataFrame([("bad", len(r.verify_integrity(deep=True))), ("thinned", states.count("thinned")), ("purged", states.count("purged"))], "kind string, n int")


@query("SELECT 1 AS children, 3 AS branches, 1 AS events, 3 AS mismatched FROM (SELECT 1)")
def children_and_drift(spark, sf_dir):
    s = shop(spark, sf_dir)
    refs = s.repo.refs()
    n = refs.where("parent = 'main'").count()
    return spark.createDataFrame([(int(n > 0), n, s.repo.drift_events("nation"), s.drift["mismatched"])], "children int, branches int, events int, mismatched int")


@query("SELECT * FROM (VALUES ('states', true), ('versions', true)) v(what, holds)")
def dropped_history(spark, sf_dir):
    """A dropped range, after a compaction: heads, tags and child branches read as before, and versions went."""
    return spark.createDataFrame(shop(spark, sf_dir).noted["dropped"], "what string, holds boolean")


@query("SELECT n_nationkey, n_name, 10 + n_nationkey % 4 AS n_regionkey FROM nation WHERE n_nationkey > 3")
def read_after_drop(spark, sf_dir):
    return shop(spark, sf_dir).repo.read("nation")


@query("SELECT n_name, count(*) AS n_versions FROM nation GROUP BY n_name")
def export_bodies(spark, sf_dir):
    """Version records of an export, read back from its text, the backfill alone."""
    r = shop(spark, sf_dir).repo
    path = f"{r.path}/exported"
    r.export("nation", path)
    body = F.from_json("value", "record string, seq_from long, op int, values struct<n_name string, n_nationkey string>")
    lines = spark.read.text(f"{path}/part=3").select(body.alias("x")).where("x.record = 'version' AND x.seq_from = 0")
    return lines.groupBy(F.col("x.values.n_name").alias("n_name")).agg(F.count("*").alias("n_versions"))


@query("SELECT p_partkey, trim(trailing '.' FROM trim(trailing '0' FROM round(p_retailprice::DECIMAL(20, 2)::DECIMAL(38, 12) / 3, 12)::DECIMAL(38, 12)::VARCHAR)) AS third FROM part WHERE round(p_retailprice * 100)::BIGINT % 3 = 0")
def rounded_quotients(spark, sf_dir):
    """Quotients to twelve places; those that end earlier have no zeros behind."""
    p = table(spark, sf_dir, "part").where("cast(round(p_retailprice * 100) AS BIGINT) % 3 = 0").select("p_partkey", F.col("p_retailprice").cast("decimal(20,2)").alias("price"))
    third = compile_expression(Arith("/", Ref("price"), Const(3)), p.schema).column
    return p.select("p_partkey", values.decimal_text(third).alias("third"))


@query("SELECT n_nationkey, [0.333333333333, 0.666666666667, 1.0][n_nationkey % 3 + 1] AS share FROM nation")
def twelve_places(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 3 + 1).cast("decimal(4,1)").alias("x"))
    return n.select("n_nationkey", compile_expression(Arith("/", Ref("x"), Const(3)), n.schema).column.cast("double").alias("share"))


@query("SELECT n_nationkey, [1.3, 2.3, 3.3][n_nationkey % 3 + 1] AS total FROM nation")
def float_operands(spark, sf_dir):
    """A double counts by its shortest text: 1.1 and 0.2 are 1.3."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 3 + F.lit(1.1)).alias("x"))
    n = n.withColumn("x", F.round("x", 1))
    return n.select("n_nationkey", compile_expression(Arith("+", Ref("x"), Const(Decimal("0.2"))), n.schema).column.cast("double").alias("total"))


@query("SELECT * FROM (VALUES (1, 'p_partkey'), (2, 'p_name'), (3, 'p_brand'), (4, 'p_type'), (5, 'p_size'), (6, 'p_retailprice'), (7, 'margin')) v(id, name)")
def loaded_schema(spark, sf_dir):
    return spark.createDataFrame([(c.id, c.name) for c in shop(spark, sf_dir).repo.schema("part", "sale").columns], "id int, name string")


@query("SELECT * FROM (VALUES ('add_column', 'margin', 0), ('rename_column', 'title', 3)) v(kind, name, level)")
def schema_changes(spark, sf_dir):
    r = shop(spark, sf_dir).repo
    found = sc.diff(r._schema_at("part", r._chain("main", "v1", None)), r.schema("part", "names"))
    return spark.createDataFrame([(c.kind, c.after.name, int(c.level)) for c in found], "kind string, name string, level int")


@query("SELECT * FROM (VALUES ('int', 'bigint', 1), ('bigint', 'int', 3), ('decimal(10,2)', 'decimal(12,4)', 1), ('decimal(10,2)', 'decimal(10,4)', 2), ('varchar(9)', 'varchar(5)', 2), ('float', 'double', 1), ('string', 'date', 3)) v(before, after, level)")
def type_change_classes(spark, sf_dir):
    pairs = [("int", "bigint"), ("bigint", "int"), ("decimal(10,2)", "decimal(12,4)"), ("decimal(10,2)", "decimal(10,4)"), ("varchar(9)", "varchar(5)"), ("float", "double"), ("string", "date")]
    return spark.createDataFrame([(a, b, int(sc.classify_type(a, b)[0])) for a, b in pairs], "before string, after string, level int")


@query("SELECT * FROM (VALUES ('result', 1, 'id'), ('result', 3, 'both'), ('result', 4, 'theirs'), ('conflict', 2, 'price')) v(part, id, name)")
def schema_three_way(spark, sf_dir):
    base = sc.Version((sc.Column(1, "id", "bigint", False), sc.Column(2, "price", "int")), (1,))
    ours = sc.Version((base.columns[0], sc.Column(2, "price", "bigint"), sc.Column(3, "both", "string")), (1,))
    theirs = sc.Version((base.columns[0], sc.Column(2, "price", "double"), sc.Column(3, "both", "string"), sc.Column(4, "theirs", "string")), (1,))
    out = sc.merge(base, ours, theirs)
    return spark.createDataFrame([("result", c.id, c.name) for c in out.result.columns] + [("conflict", i, n) for i, n, _ in out.conflicts], "part string, id int, name string")


@query("SELECT 1 AS plan, 'part' AS \"table\", 'main' AS target, 'applied' AS state, 1 AS steps, 1 AS done")
def migration_plans(spark, sf_dir):
    return shop(spark, sf_dir).repo.plans()


@query("""SELECT * FROM (VALUES ('plan', 'ALTER TABLE `part` ADD COLUMN `margin` int'), ('spark', 'ALTER TABLE `t` ALTER COLUMN `c` TYPE bigint'), ('postgres', 'ALTER TABLE "t" ALTER COLUMN "c" TYPE bigint'), ('mysql', 'ALTER TABLE `t` MODIFY COLUMN `c` bigint'),
 ('create', 'CREATE TABLE "t" ("c" bigint NOT NULL, PRIMARY KEY ("c"))')) v(dialect, statement)""")
def ddl_statements(spark, sf_dir):
    step = sc.Step(0, "alter_type", sc.Class.WIDENING, sc.Column(1, "c", "bigint"))
    rows = [("plan", x) for x in shop(spark, sf_dir).statements] + [(d, x) for d in ddl.DIALECTS for x in ddl.statements("t", step, d)]
    return spark.createDataFrame([*rows, ("create", ddl.create_table("t", sc.Version((sc.Column(1, "c", "bigint", False),), (1,)), "postgres"))], "dialect string, statement string")


def _hex_text(text: str) -> str:
    return f"{len(text.encode()):08x}{text.encode().hex()}"


_SHAPE = "04" + f"{2:016x}" + f"{3:08x}" + "".join(f"{i:08x}{_hex_text(n)}{_hex_text(k)}{flags:02x}" for i, n, k, flags in ((1, "n_nationkey", "int", 2), (2, "n_name", "string", 1), (3, "n_regionkey", "int", 1)))


@query(f"SELECT lower(sha256(unhex('{_SHAPE}'))) AS digest")
def schema_digest(spark, sf_dir):
    r = shop(spark, sf_dir).repo
    version = r.schema("nation")
    columns = [(c.id, c.name, c.type, c.nullable, c.id in version.pk) for c in version.columns]
    return spark.createDataFrame([(encoding.schema_digest(2, columns).hex(),)], "digest string")


@query("SELECT * FROM (VALUES (1), (2), (5), (6), (11)) v(seq)")
def protected_commits(spark, sf_dir):
    """Seqs of main on which a branch, a tag or an open session stands."""
    r = shop(spark, sf_dir).repo
    return spark.createDataFrame([(q,) for q in sorted(r.pinned(r.state["branches"]["main"]["id"]))], "seq int")


@query("SELECT c_custkey, CASE WHEN c_custkey = 7 THEN '<erased>' ELSE c_name END AS c_name FROM customer")
def erased_history(spark, sf_dir):
    """A state from before an erasure: the subject's sealed column reads as erased, others as they were."""
    s = shop(spark, sf_dir)
    return s.repo.read("people", at=s.at["known"]).select("c_custkey", "c_name")


@query("SELECT count(*) AS n_rows, true AS sealed, true AS wrapped FROM customer WHERE c_custkey <= 200")
def sealed_columns(spark, sf_dir):
    """What is stored: sealed text, and keys of 32 bytes under a wrapping key, so longer than a key."""
    r = shop(spark, sf_dir).repo
    stored = spark.read.parquet(*{f"{r.path}/{f['path']}" for f in r.state["tables"]["people"]["files"]}).where("op = 1")
    keys = spark.read.parquet(*[f"{r.path}/{f}" for f in r.state["key_files"]]).agg((F.min(F.length("key")) > 32).alias("wrapped"))
    return stored.agg(F.count_if(F.col("c_1") <= 200).alias("n_rows"), F.min(F.col("c_2").startswith("tidemark:enc:")).alias("sealed")).crossJoin(keys)


@query("SELECT * FROM (VALUES ('checkpoint', true), ('commit', true), ('other key', false)) v(what, holds)")
def signatures(spark, sf_dir):
    s = shop(spark, sf_dir)
    signed = access.sign_commit(s.repo, s.at["fix"], SECRET)
    rows = [("checkpoint", access.verify_checkpoint(s.repo, access.checkpoint(s.repo, "main", SECRET), SECRET)), ("commit", access.verify_commit(s.repo, s.at["fix"], SECRET, signed)), ("other key", access.verify_commit(s.repo, s.at["fix"], b"other", signed))]
    return spark.createDataFrame(rows, "what string, holds boolean")


_LEAVES = """SELECT lower(sha256(unhex('00' || printf('%016x', 7) || printf('%08x', 4 + 9) || '00000001' || '02' || printf('%016x', n_nationkey) || '01' || '00000000' || '00000001' || '0000000102' || printf('%016x', n_nationkey)))) AS leaf FROM nation"""


@query(f"""WITH RECURSIVE up(l) AS (SELECT list(leaf ORDER BY leaf) FROM ({_LEAVES}) UNION ALL
 SELECT list_transform(range(1, (len(l) + 1) // 2 + 1), lambda i: CASE WHEN 2 * i <= len(l) THEN lower(sha256(unhex('01' || l[2 * i - 1] || l[2 * i]))) ELSE l[2 * i - 1] END) FROM up WHERE len(l) > 1) SELECT l[1] AS root FROM up WHERE len(l) = 1""")
def merkle_root(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = (F.col("n_nationkey"), n.schema["n_nationkey"].dataType)
    leaf = encoding.leaf_digest(7, F.lit(1), F.array().cast("array<int>"), [key], [(1, *key)])
    return spark.createDataFrame([(encoding.merkle_root(n.select(leaf.alias("leaf"))).hex(),)], "root string")


_BUCKETS = f"SELECT (SELECT count(*) FROM (SELECT unnest([{', '.join(repr(b) for b in metrics.BOUNDS)}]::DOUBLE[]) AS b) WHERE b < x) AS bucket FROM (SELECT value::DOUBLE AS x FROM events WHERE value IS NOT NULL)"
_BOUND = f"[{', '.join(repr(b) for b in [*metrics.BOUNDS, metrics.BOUNDS[-1]])}]::DOUBLE[]"


@query(f"""WITH c AS (SELECT bucket, count(*) AS n FROM ({_BUCKETS}) GROUP BY bucket), s AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS upto, sum(n) OVER () AS n FROM c)
 SELECT max(n)::BIGINT AS n, {', '.join(f"({_BOUND})[min(bucket) FILTER (upto >= {q} * n) + 1] AS p{round(100 * q)}" for q in metrics.QUANTILES)} FROM s""")
def latency_summary(spark, sf_dir):
    return metrics.latency_summary(table(spark, sf_dir, "events"), "value")


@query(f"SELECT * FROM (SELECT p_partkey, 2 AS op, p_name, margin FROM ({_MERGED}) WHERE p_name = 'sale' OR margin = 7 ORDER BY p_partkey LIMIT 10)")
def merge_changes_in_order(spark, sf_dir):
    """The first changes of a merge that was not applied, in the order of their keys."""
    return shop(spark, sf_dir).preview.limit(10).select("p_partkey", "op", "p_name", "margin")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return changes.bad_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
