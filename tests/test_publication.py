"""Changes are published whole or not at all; what grows with the commits stays cheap; kept states stay as they are."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark import metrics
from tidemark.access import Denied
from tidemark.cli import main as cli
from tidemark.operators import merge as mg
from tidemark.repository import Refused, Repository
from tidemark.sources.control import Conflict, NotFound


class Clock:
    now = 0

    def __call__(self):
        self.now += 1
        return self.now


@pytest.fixture
def repo(spark, tmp_path):
    r = Repository.create(spark, str(tmp_path / "r"), "r", "ada", Clock())
    r.track("t", spark.createDataFrame([(i, i * 10) for i in range(6)], "k int, v int"), ["k"])
    return r


def write(repo, rows, branch="main", message=""):
    return repo.commit("t", repo.spark.createDataFrame(rows, "k int, v int, op int"), branch, "ada", message)


def state(repo, **where):
    return {r.k: r.v for r in repo.read("t", **where).collect()}


def folders(repo, tmp_path):
    return sorted(p.name for p in (tmp_path / "r" / "data" / "t").iterdir())


@pytest.mark.parametrize("step", ["_file_schema", "_change_digest", "_append", "publish"])
def test_a_commit_that_fails_at_any_step_leaves_nothing(repo, spark, tmp_path, step, monkeypatch):
    before, seen = folders(repo, tmp_path), state(repo)

    def fail(*args, **kwargs):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(repo.store if step == "publish" else repo, step, fail)
        with pytest.raises(OSError):
            write(repo, [(1, 99, 2), (2, None, 3)])
        with pytest.raises(OSError):
            repo.update_where("t", None, {"v": 0}, author="ada") if step != "publish" else write(repo, [(3, 1, 2)])
    assert state(repo) == seen and folders(repo, tmp_path) == before
    write(repo, [(5, 55, 2)])
    want = {**seen, 5: 55}
    assert state(repo) == want and state(Repository.open(spark, repo.path)) == want
    assert repo.verify_integrity(deep=True) == [] and len(folders(repo, tmp_path)) == len(before) + 1


def test_tracking_and_sessions_that_fail_leave_nothing(repo, spark, monkeypatch):
    repo.branch("b")
    session = repo.open_session("b", "ada")
    rows = spark.createDataFrame([(1, 7)], "k int, v int")
    with monkeypatch.context() as m:
        m.setattr(repo.store, "publish", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            repo.track("u", rows, ["k"])
        with pytest.raises(OSError):
            repo.session_write(session, "t", rows)
    assert "u" not in repo.state["tables"] and state(repo, session=session)[1] == 10
    repo.track("u", rows, ["k"])
    assert repo.read("u").count() == 1


def test_an_update_from_the_parent_is_one_publication(repo, monkeypatch):
    repo.branch("b")
    write(repo, [(0, 1, 2)], "b")
    write(repo, [(1, 2, 2)])
    published = []
    whole = repo.store.publish
    monkeypatch.setattr(repo.store, "publish", lambda v, s: published.append(v) or whole(v, s))
    repo.update_from_parent("t", "b", "ada")
    assert len(published) == 1 and state(repo, branch="b") == {0: 1, 1: 2, 2: 20, 3: 30, 4: 40, 5: 50}
    write(repo, [(2, 3, 2)], "b")
    done = repo.merge("t", "b", "main", "ada")
    assert done.clean and state(repo) == {0: 1, 1: 2, 2: 3, 3: 30, 4: 40, 5: 50}


def test_losing_writers_see_the_winner(repo, spark):
    other = Repository.open(spark, repo.path)
    write(repo, [(0, 1, 2)])
    with pytest.raises(Conflict):
        write(other, [(0, 2, 2)])
    assert state(other)[0] == 1
    write(other, [(0, 2, 2)])
    repo.refresh()
    assert state(repo)[0] == 2


def test_dropped_history_keeps_every_state_that_is_stood_on(repo):
    for i in range(1, 6):
        write(repo, [(0, i, 2), (i, None, 3)] if i != 3 else [(0, 3, 2), (1, 11, 1)])
        if i == 2:
            repo.tag("two", "main")
            repo.branch("child")
    old = repo.state["tags"]["two"]["commit"]
    kept = [state(repo), state(repo, at="two"), state(repo, branch="child"), state(repo, at=old)]
    n = repo.log("t").count()
    gone = repo.drop_history("t", "main", 0, 5)
    assert gone > 0 and repo.log("t").count() == n - gone
    assert [state(repo), state(repo, at="two"), state(repo, branch="child"), state(repo, at=old)] == kept
    assert 2 not in state(repo) and state(repo)[1] == 11
    four = repo.commits("main").where("seq = 4").first().commit_id
    for call in (lambda: repo.read("t", at=four), lambda: repo.diff("t", from_seq=1, to_seq=4)):
        with pytest.raises(NotFound):
            call()
    repo.compact("t")
    assert repo.drop_history("t", "main", 0, 5) == 0 and repo.drop_history("t", "main", 5, 6) == 0
    assert state(repo) == kept[0] and repo.verify_integrity(deep=True) == []


def test_control_states_stay_small_and_merge_bases_quick(repo, spark):
    big = repo.state["commits"][repo.state["branches"]["main"]["head"]]
    last = big["id"]
    for i in range(100_000):
        c = f"{i:064x}"
        repo.state["commits"][c] = {**big, "id": c, "parents": [last], "seq": i}
        last = c
    repo.state["branches"]["main"]["head"] = last
    repo.state["branches"]["far"] = {**repo.state["branches"]["main"], "head": f"{500:064x}"}
    began = time.time()
    assert repo.merge_base("main", "far") == [f"{500:064x}"]
    assert time.time() - began < 1
    sizes = []
    for i in range(3):
        with repo._change():
            repo.state["commits"][f"x{i}"] = {**big, "id": f"x{i}", "parents": [last]}
        sizes.append(len(repo.store._logs["commits"]))
    head = repo.store._fs().getFileStatus(repo.store._at("_control", f"{repo.version:012d}.json")).getLen()
    assert head < 20_000 and max(sizes) < 20
    assert len(Repository.open(spark, repo.path).state["commits"]) == len(repo.state["commits"])
    assert repo.store.expire(1) > 0 and len(Repository.open(spark, repo.path).state["commits"]) == len(repo.state["commits"])


def test_a_merge_reads_twice_and_shuffles_what_changed(repo, spark):
    repo.branch("b")
    write(repo, [(0, 1, 2)], "b")
    write(repo, [(1, 2, 2)])
    r = repo.state["branches"]
    base, ours, theirs = [tuple(map(tuple, c)) for c in (repo.state["commits"][r["b"]["fork"]]["chain"], r["main"]["chain"], r["b"]["chain"])]
    sides = mg.three_way_scan(repo.log("t"), list(base), list(ours), list(theirs), ["k"], ["v"])
    changes = mg.merge_changes(mg.judge(sides, ["k"], ["v"]), ["k"], ["v"])
    text = changes._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line for line in text.splitlines()) <= 2
    physical = changes._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") <= 2
    assert {(x.k, x.op, x.v) for x in changes.collect()} == {(0, 2, 1)}
    same = mg.three_way_scan(repo.log("t"), list(base), list(base), list(theirs), ["k"], ["v"])
    assert same._jdf.queryExecution().optimizedPlan().toString().count("max_by") == 2


def test_violations_are_all_reported(spark, tmp_path):
    repo = Repository.create(spark, str(tmp_path / "u"), "u", "ada", Clock())
    repo.track("t", spark.createDataFrame([(i, f"n{i}") for i in range(1500)], "k int, name string"), ["k"], unique=[["name"]])
    doubled = spark.range(1500).select((F.col("id") + 5000).cast("int").alias("k"), F.concat(F.lit("n"), "id").alias("name"), F.lit(1).alias("op"))
    found = repo.validate("t", "main", doubled)
    assert found.count() == 1500 and found.select("rows").distinct().collect()[0].rows == 2
    moved = spark.createDataFrame([(0, "n1", 2), (1, "n0", 2), (2, None, 2), (3, None, 2)], "k int, name string, op int")
    assert repo.validate("t", "main", moved).isEmpty()


def test_calls_need_capabilities_once_granted(repo, spark):
    with pytest.raises(Refused):
        repo.grant("bob", "read")
    repo.grant("ada", "admin", key="ada's key")
    ada = Repository.open(spark, repo.path, Clock(), key="ada's key")
    ada.grant("bob", "write")
    with pytest.raises(Denied):
        Repository.open(spark, repo.path, key="no key")
    bob = Repository.open(spark, repo.path, Clock(), principal="bob")
    write(bob, [(0, 5, 2)])
    assert state(bob)[0] == 5
    keys = spark.createDataFrame([(0,)], "k int")
    for call in (lambda: bob.branch("x"), lambda: bob.protect("main"), lambda: bob.purge("t", keys, "asked", "bob"), lambda: bob.drop_history("t", "main", 0, 1)):
        with pytest.raises(Denied):
            call()
    ada.refresh()
    ada.branch("x")
    with pytest.raises(Denied):
        ada.purge("t", keys, "asked", "ada")
    ada.grant("ada", "purge")
    with pytest.raises(Refused):
        ada.purge("t", keys, " ", "ada")
    assert ada.purge("t", keys, "asked", "ada") == 2
    with pytest.raises(Denied):
        Repository.open(spark, repo.path).read("t")


def test_keys_are_wrapped_and_read_with_the_wrapping_key_alone(spark, tmp_path):
    path, key = str(tmp_path / "p"), bytes(range(1, 33))
    repo = Repository.create(spark, path, "p", "ada", Clock(), wrapping_key=key)
    repo.track("t", spark.createDataFrame([(1, "s1", "secret"), (2, "s2", None)], "k int, who string, x string"), ["k"])
    repo.designate_pii("t", "x", "who")
    seen = lambda **o: {r.k: r.x for r in Repository.open(spark, path, **o).read("t").collect()}
    assert seen(wrapping_key=key) == {1: "secret", 2: None}
    assert seen(wrapping_key=bytes(32)) == seen() == {1: "<erased>", 2: None}
    with pytest.raises(Refused):
        Repository.create(spark, str(tmp_path / "q"), "q", "ada", Clock()).track("t", spark.createDataFrame([(1, "a")], "k int, x string"), ["k"]) or Repository.open(spark, str(tmp_path / "q")).designate_pii("t", "x", "k")


def test_metrics(repo, spark):
    write(repo, [(0, 1, 2)])
    state(repo)
    found = repo.metrics.summary()
    assert found["commits"] == 1 and found["rows"] == 1 and found["depths"][1] >= 1 and found["commit_p50"] in metrics.BOUNDS
    assert metrics.quantile([0] * 5, 0.5) is None and metrics.quantile([1, 0, 0, 1], 0.5) == metrics.BOUNDS[0]
    df = spark.createDataFrame([(0.0001,), (0.00011,), (3.0,), (1000.0,), (None,)], "s double")
    assert sorted((r.up_to or 0, r.n) for r in metrics.histogram(df, "s").collect()) == [(0, 1), (0.0001, 1), (0.0002, 1), (5.0, 1)]
    assert tuple(metrics.latency_summary(df, "s").first()) == (4, 0.0002, 100.0, 100.0)
    assert metrics.latency_summary(df.limit(0), "s").first().n == 0


def test_commands_for_changes_sessions_and_proposals(repo, spark, tmp_path, capsys):
    run = lambda *args: cli([repo.path, *map(str, args)], spark)
    said = lambda: capsys.readouterr().out.strip().splitlines()[-1]
    run("branch", "b")
    run("update", "t", "v=7", "--where", "k >= 2 and k != 4", "--branch", "b")
    assert said() == "3"
    run("delete", "t", "k = 0", "--branch", "b")
    run("session-open", "b", "bob")
    session = said()
    spark.createDataFrame([(1, 100)], "k int, v int").write.parquet(str(tmp_path / "rows"))
    run("session-write", session, "t", tmp_path / "rows")
    run("session-commit", session, "t")
    run("propose", "b", "main", "change")
    assert said() == "1"
    run("review", 1, "approve", "eve")
    assert run("merge-proposal", 1, "t", "ada") == 0
    repo.refresh()
    assert state(repo) == {1: 100, 2: 7, 3: 7, 4: 40, 5: 7}
    run("purge", "t", "k=4", "asked")
    repo.refresh()
    assert state(repo) == {1: 100, 2: 7, 3: 7, 5: 7} and repo.proposals("merged").count() == 1
