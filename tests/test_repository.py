"""The repository against a snapshot model, and its rules one by one."""

import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.cli import main as cli
from tidemark.functions.expressions import Arith, Const, Ref
from tidemark.functions.predicates import Col
from tidemark.functions.values import UnsupportedType
from tidemark.operators.changes import DuplicateKey
from tidemark.repository import NotFound, Refused, Repository
from tidemark.sources.control import Conflict
from tidemark.streaming.ingest import ingest

PRODUCTS = "sku string, name string, category string, price decimal(12,2), updated_at timestamp"
DAY = datetime(2026, 3, 2)
ROWS = [("LAMP-2", "Desk lamp", "light", Decimal("240.00"), DAY), ("BULB-7", "Warm bulb", "light", Decimal("85.00"), DAY), ("DESK-3", "Oak desk", "wood", Decimal("12.00"), DAY)]


class Clock:
    def __init__(self):
        self.now = 1_700_000_000_000_000

    def __call__(self):
        self.now += 1_000_000
        return self.now


@pytest.fixture
def repo(spark, tmp_path):
    r = Repository.create(spark, str(tmp_path / "catalog"), "catalog", "ada", Clock())
    r.track("products", spark.createDataFrame(ROWS, PRODUCTS), ["sku"], unique=[["name"]])
    return r


def price(repo, sku="LAMP-2", **where):
    return repo.get("products", {"sku": sku}, **where)["price"]


def put(repo, branch="main", author="ada", **values):
    """Commits one product with some columns replaced."""
    spark, sku = repo.spark, values.pop("sku", "LAMP-2")
    row = {**repo.get("products", {"sku": sku}, branch=branch), **values}
    return repo.commit("products", spark.createDataFrame([tuple(row[c] for c in ("sku", "name", "category", "price", "updated_at"))], PRODUCTS), branch, author)


def test_time_travel(repo):
    first = put(repo, price=Decimal("255"))
    second = put(repo, price=Decimal("276.00"))
    at = repo.state["commits"][first.commit]["at"]
    assert (price(repo), price(repo, at=first.commit), price(repo, as_of=at)) == (Decimal("276.00"), Decimal("255"), Decimal("255"))
    with pytest.raises(NotFound):
        repo.read("products", as_of=1)
    assert [r.seq for r in repo.history_log().collect()] == [2, 1, 0] and second.seq == 2
    assert repo.verify_integrity(deep=True) == []
    repo.state["commits"][first.commit]["message"] = "forged"
    assert repo.verify_integrity() == [first.commit]
    found = repo.history("products", keys=repo.spark.createDataFrame([("LAMP-2",)], "sku string")).collect()
    assert [(r.seq_from, r.op, r.author) for r in found] == [(2, 2, "ada"), (1, 2, "ada"), (0, 1, "ada")]
    blamed = {r.column: r.commit_id for r in repo.blame("products").where("sku = 'LAMP-2'").collect()}
    assert blamed["price"] == second.commit and blamed["name"] not in (first.commit, second.commit)
    back = repo.revert("products", second.commit, author="ada")
    assert price(repo) == Decimal("255") and back.changed == 1
    with pytest.raises(Refused):
        repo.revert("products", first.commit, author="ada")


def test_updates_by_predicate(repo):
    done = repo.update_where("products", Col("category") == "light", {"price": Arith("*", Ref("price"), Const(Decimal("1.15")))}, author="ada")
    assert done.changed == 2 and price(repo) == Decimal("276.00") and price(repo, "BULB-7") == Decimal("97.75")
    assert repo.commit("products", repo.read("products"), author="ada").changed == 0
    assert {(r.sku, r.op) for r in repo.diff("products", from_seq=0).collect()} == {("LAMP-2", 2), ("BULB-7", 2)}
    repo.branch("b")
    put(repo, "b", sku="DESK-3", category="light")
    assert repo.read("products", "b", where=Col("category") == "light").count() == 3
    assert repo.read("products", where=Col("category") == "light").count() == 2
    assert repo.delete_where("products", Col("category") == "wood", author="ada").changed == 1
    assert repo.read("products").count() == 2 and repo.read("products", "b").count() == 3


def test_validation(repo):
    rename = lambda name: repo.read("products").where("sku = 'DESK-3'").withColumn("name", F.lit(name)).withColumn("op", F.lit(2))
    found = repo.validate("products", "main", rename("Warm bulb")).collect()
    assert [(v.rule, v.columns, v.value, v.rows) for v in found] == [("unique", ["name"], ["Warm bulb"], 2)]
    assert repo.validate("products", "main", rename("Oak desk XL")).isEmpty()


def test_refusals(repo, spark):
    df = spark.createDataFrame([(1, [1.0])], "id int, v array<float>")
    with pytest.raises(UnsupportedType):
        repo.track("vectors", df, ["id"])
    with pytest.raises(Refused):
        repo.track("nokey", df.drop("v"), [])
    with pytest.raises(DuplicateKey):
        repo.track("twice", spark.createDataFrame([(1,), (1,)], "id int"), ["id"])
    with pytest.raises(Refused):
        repo.commit("products", repo.read("products"))
    with pytest.raises(Conflict):
        repo.commit("products", repo.read("products"), author="ada", expected_head="0")
    other = Repository.open(spark, repo.path)
    put(repo, price=Decimal("1"))
    with pytest.raises(Conflict):
        other.branch("late")
    other.branch("late")
    repo.refresh()
    for i in range(8):
        repo.branch(f"d{i + 1}", f"d{i}" if i else "main") if i < 7 else None
    with pytest.raises(ValueError):
        repo.branch("d9", "d7")
    with pytest.raises(Refused):
        repo.delete_branch("d1")
    with pytest.raises(Refused):
        repo.delete_branch("main")


def test_merges_conflicts_and_proposals(repo, spark):
    repo.branch("sale")
    put(repo, "sale", price=Decimal("200"))
    put(repo, name="Tall lamp")
    clean = repo.merge("products", "sale", "main", "ada")
    assert clean.clean and price(repo) == Decimal("200") and repo.get("products", {"sku": "LAMP-2"})["name"] == "Tall lamp"
    assert len(repo.state["commits"][clean.commit]["parents"]) == 2
    put(repo, "sale", price=Decimal("190"))
    put(repo, price=Decimal("210"))
    stuck = repo.merge("products", "sale", "main", "ada")
    assert not stuck.clean and [(r.kind, r.column, r.ours_value, r.theirs_value) for r in stuck.conflicts.collect()] == [("cell", "price", "210.00", "190.00")]
    assert price(repo) == Decimal("210")
    repo.protect("main", True, 1)
    n = repo.propose("sale", "main", "Cheaper", "bob")
    with pytest.raises(Refused):
        repo.review(n, "approve", "bob")
    with pytest.raises(Refused):
        repo.merge_proposal(n, "products", "ada")
    repo.review(n, "request_changes", "eve")
    repo.review(n, "approve", "ada")
    with pytest.raises(Refused):
        repo.merge_proposal(n, "products", "ada")
    repo.review(n, "approve", "eve")
    assert not repo.merge_proposal(n, "products", "ada").clean
    repo.resolve_conflict(n, {"sku": "LAMP-2"}, "theirs", "price")
    assert repo.merge_proposal(n, "products", "ada").clean and price(repo) == Decimal("190")
    assert repo.proposals("merged").count() == 1


def test_update_from_parent_moves_one_branch(repo):
    repo.branch("a")
    repo.branch("b", "a")
    put(repo, sku="DESK-3", price=Decimal("15"))
    assert price(repo, "DESK-3", branch="a") == Decimal("12.00")
    repo.update_from_parent("products", "a", "ada")
    assert price(repo, "DESK-3", branch="a") == Decimal("15") and price(repo, "DESK-3", branch="b") == Decimal("12.00")
    assert repo.update_from_parent("products", "a", "ada") is None
    assert repo.merge("products", "a", "main", "ada").changes.count() == 0


def test_sessions(repo, spark):
    repo.branch("work")
    with pytest.raises(Refused):
        repo.open_session("main", "ada")
    s, other = repo.open_session("work", "ada"), repo.open_session("work", "bob")
    row = repo.read("products").where("sku = 'DESK-3'")
    repo.session_write(s, "products", row.withColumn("price", F.lit(1)))
    repo.session_write(s, "products", row.withColumn("price", F.lit(2)))
    repo.session_write(other, "products", row.withColumn("price", F.lit(9)))
    see = lambda **w: repo.read("products", where=Col("sku") == "DESK-3", **w).first().price
    assert (see(session=s), see(session=other), see(branch="work")) == (2, 9, 12)
    assert repo.commit_session(s, "products", "ada").changed == 1 and see(branch="work") == 2
    with pytest.raises(Conflict):
        repo.commit_session(other, "products", "bob")
    repo.abandon_session(other)
    with pytest.raises(NotFound):
        repo.read("products", session=other)
    late = repo.open_session("work", "ada")
    repo.clock.now += 2 * 24 * 3600 * 1_000_000
    assert repo.reap_sessions() == 1 and repo.state["sessions"][late]["state"] == "expired"


def test_schema_changes(repo, spark):
    with pytest.raises(Refused):
        repo.alter_schema("products", "main", [])
    repo.branch("wide")
    before = repo.state["branches"]["main"]["head"]
    columns = [(c.name, c.type, c.nullable) for c in repo.schema("products").columns]
    repo.alter_schema("products", "wide", [*columns, ("margin", "decimal(5,2)", True)])
    put_row = repo.read("products", "wide").where("sku = 'DESK-3'").withColumn("margin", F.lit(1.5))
    repo.commit("products", put_row, "wide", "ada")
    assert "margin" not in repo.read("products").columns
    plan = repo.merge_schema("products", "wide", "main")["plan"]
    repo.apply_plan(plan)
    assert repo.merge("products", "wide", "main", "ada").clean
    assert repo.read("products").where("margin = 1.5").count() == 1 and "margin" not in repo.read("products", at=before).columns
    repo.branch("narrow")
    repo.alter_schema("products", "narrow", columns)
    plan = repo.merge_schema("products", "narrow", "main")["plan"]
    with pytest.raises(Refused):
        repo.apply_plan(plan)
    with pytest.raises(RuntimeError):
        repo.apply_plan(plan, confirm=True, crash_after=1)
    assert repo.plans("pending").first().done == 1
    repo.apply_plan(plan, confirm=True)
    assert "margin" not in repo.read("products").columns and repo.plans("applied").count() == 2


def test_retention(repo, spark):
    for i in range(6):
        put(repo, price=Decimal(250 + i))
    versions = repo.log("products").count()
    repo.tag("v3", repo.commits("main").where("seq = 3").first().commit_id)
    repo.prune("products", keep_commits=2)
    assert price(repo, at="v3") == Decimal(252)
    del repo.state["tags"]["v3"]
    assert repo.prune("products", keep_commits=2) > 0
    assert repo.log("products").count() < versions and price(repo) == Decimal(255)
    assert repo.verify_intervals("products").where("fault <> 'gap'").count() == 0
    repo.branch("gone")
    put(repo, "gone", price=Decimal(1))
    repo.delete_branch("gone")
    assert repo.gc(grace_s=10**6) == 0 and repo.gc() == 1
    assert repo.purge("products", spark.createDataFrame([("DESK-3",)], "sku string"), "asked", "ada") == 1
    assert repo.read("products").count() == 2
    assert repo.verify_drift("products", spark.createDataFrame(ROWS, PRODUCTS)) == {"live_only": 1, "version_only": 0, "mismatched": 1}
    repo.set_write_mode("products", "guarded")
    with pytest.raises(Refused):
        repo.capture("products", spark.createDataFrame(ROWS, PRODUCTS))
    repo.set_write_mode("products", "capture")
    repo.capture("products", spark.createDataFrame(ROWS, PRODUCTS))
    assert repo.drift_events("products") == 1
    state = sorted(map(tuple, repo.read("products").collect()))
    repo.compact("products")
    assert sorted(map(tuple, repo.read("products").collect())) == state


def test_personal_data(spark, tmp_path):
    repo = Repository.create(spark, str(tmp_path / "c"), "c", "ada", Clock(), wrapping_key=bytes(range(32)))
    people = [("C1", "cust-1", "ada@example.com"), ("C2", "cust-2", "grace@example.com"), ("C3", "cust-2", None)]
    repo.track("contacts", spark.createDataFrame(people, "id string, customer string, email string"), ["id"])
    repo.commit("contacts", spark.createDataFrame([("C1", "cust-1", "ada@new.example")], "id string, customer string, email string"), author="ada")
    first = repo.state["branches"]["main"]["head"]
    repo.designate_pii("contacts", "email", "customer")
    with pytest.raises(Refused):
        repo.designate_pii("contacts", "id", "customer")
    stored = spark.read.parquet(*[f"{repo.path}/{f['path']}" for f in repo.state["tables"]["contacts"]["files"]])
    assert all(r.c_3 is None or r.c_3.startswith("tidemark:enc:") for r in stored.collect())
    assert {r.id: r.email for r in repo.read("contacts").collect()} == {"C1": "ada@new.example", "C2": "grace@example.com", "C3": None}
    old = {(r.id, r.seq_from): r.email for r in repo.history("contacts").collect()}
    assert old["C1", 0] == "ada@example.com" and old["C1", 1] == "ada@new.example"
    assert repo.commit("contacts", repo.read("contacts"), author="ada").changed == 0
    with pytest.raises(Exception, match="names no subject"):
        repo.commit("contacts", spark.createDataFrame([("C4", None, "who@example.com")], "id string, customer string, email string"), author="ada")
    repo.refresh()
    repo.erase_subject("contacts", "cust-1", "ada", "asked")
    assert {r.id for r in repo.read("contacts").collect()} == {"C2", "C3"}
    assert {r.email for r in repo.read("contacts", at=first).where("id = 'C1'").collect()} == {"<erased>"}


def test_sinks_streams_and_commands(repo, spark, tmp_path, capsys):
    repo.materialize("main", "m_")
    assert spark.sql("SELECT count(*) AS n FROM m_products WHERE price > 50").first().n == 2
    repo.export("products", str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).select("value").collect()]
    assert sum('"record":"version"' in x for x in lines) == 3 and sum('"record":"column"' in x for x in lines) == 5 and any('"price":"240"' in x for x in lines)
    source = str(tmp_path / "in")
    for i in range(2):
        spark.createDataFrame([("DESK-3", f"mug {i}", "wood", Decimal(i + 1), DAY, i), ("NEW", f"new {i}", "wood", Decimal(i + 1), DAY, i)], PRODUCTS + ", n int").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(PRODUCTS + ", n int").parquet(source)
    for _ in range(2):
        ingest(stream, repo, "products", str(tmp_path / "check"), "stream", order="n").awaitTermination()
    repo.refresh()
    assert price(repo, "NEW") == 2 and repo.read("products").count() == 4 and len(repo.state["once"]) == 1
    assert cli([repo.path, "log"], spark) == 0 and cli([repo.path, "verify", "--deep"], spark) == 0
    assert cli([repo.path, "sql", "SELECT count(*) FROM products"], spark) == 0
    assert "intact" in capsys.readouterr().out
    with pytest.raises(Refused):
        repo.branch("x") or put(repo, "x", price=Decimal(3)) and repo.untrack("products")
    repo.untrack("products", force=True)
    assert repo.tables().count() == 0


class Model:
    """Whole states per commit: what the log must agree with."""

    def __init__(self, rows):
        self.states = {"main": dict(rows)}
        self.base = {}

    def merge(self, base, ours, theirs):
        out, bad = {}, []
        for k in {*base, *ours, *theirs}:
            b, a, t = base.get(k), ours.get(k), theirs.get(k)
            if a == b or a == t:
                pick = t if a == b else a
            elif t == b:
                pick = a
            elif None in (a, b, t):
                bad.append(k)
                continue
            else:
                cells = [y if x == z else x if y == z or x == y else None for x, y, z in zip(a, t, b)]
                if None in cells:
                    bad.append(k)
                    continue
                pick = tuple(cells)
            if pick is not None:
                out[k] = pick
        return out, sorted(bad)


@pytest.mark.parametrize("seed", [4, 97])
def test_random_operations_agree_with_the_model(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = {f"k{i}": tuple(rng.randrange(5) for _ in range(3)) for i in range(5)}
    kind = "k string, x int, y int, z int"
    repo = Repository.create(spark, str(tmp_path / "r"), "r", "ada", Clock())
    repo.track("t", spark.createDataFrame([(k, *v) for k, v in rows.items()], kind), ["k"])
    model = Model(rows)
    forks = {}
    state = lambda b: {r.k: (r.x, r.y, r.z) for r in repo.read("t", b).collect()}
    for _ in range(7):
        branches = list(model.states)
        b = rng.choice(branches)
        act = rng.choice(["commit", "commit", "branch", "merge"])
        if act == "branch" and len(branches) < 4:
            name = f"b{len(branches)}"
            repo.branch(name, b)
            model.states[name] = dict(model.states[b])
            forks[name] = (b, dict(model.states[b]))
        elif act == "merge" and forks:
            source = rng.choice(list(forks))
            target, base = forks[source]
            want, bad = model.merge(base, model.states[target], model.states[source])
            done = repo.merge("t", source, target, "ada")
            assert done.clean == (not bad) and sorted({r.k for r in done.conflicts.collect()}) == bad
            if done.clean:
                model.states[target] = want
                forks[source] = (target, dict(model.states[source]))
        else:
            keys = rng.sample([f"k{i}" for i in range(8)], rng.randint(1, 3))
            batch = []
            for k in keys:
                if rng.random() < 0.25:
                    batch.append((k, None, None, None, 3))
                    model.states[b].pop(k, None)
                else:
                    v = tuple(rng.randrange(5) for _ in range(3))
                    batch.append((k, *v, 1))
                    model.states[b][k] = v
            repo.commit("t", spark.createDataFrame(batch, kind + ", op int"), b, "ada")
        for name, want in model.states.items():
            assert state(name) == want, (act, name)
    assert repo.verify_integrity(deep=True) == [] and repo.verify_intervals("t").isEmpty()
