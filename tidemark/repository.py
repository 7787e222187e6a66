"""A repository of versioned tables: commits, branches, merges, sessions, proposals, schemas, retention.

Rows live in Parquet folders that are only ever added; the control state names the folders with their branch
and seq, so a chain reads only its own. Every read is a lazy DataFrame.

A change works on a copy of the state, which is published in one step when the change ends, or not at all. Commits
and file entries are shared between copies, so they are replaced and never altered.
"""

from __future__ import annotations

import copy
import functools
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.access import Access
from tidemark.functions import encoding
from tidemark.functions.predicates import Predicate
from tidemark.functions.values import DELETE, INSERT, UnsupportedType, kind_of
from tidemark.operators import changes as ch
from tidemark.operators import history as hi
from tidemark.operators import merge as mg
from tidemark.operators import privacy, retention
from tidemark.operators import schema as sc
from tidemark.metrics import Metrics
from tidemark.operators import ddl
from tidemark.plans.resolve import Chain, candidate_keys, child_chain, intervals, resolve, winners
from tidemark.sources import export as ex
from tidemark.sources.connect import introspect
from tidemark.sources.control import Conflict, ControlStore, NotFound

LEASE_S = 24 * 3600
MERGE_LIMIT = 50_000
META = T.StructType([T.StructField("branch_id", T.StringType()), T.StructField("seq_from", T.LongType()), T.StructField("op", T.IntegerType()), T.StructField("session_id", T.StringType()), T.StructField("changed", T.ArrayType(T.IntegerType()))])


class Refused(RuntimeError):
    pass


@dataclass
class CommitResult:
    commit: str
    seq: int
    changed: int


@dataclass
class MergeResult:
    clean: bool
    changes: DataFrame
    conflicts: DataFrame
    violations: DataFrame
    commit: str | None = None


def _needs(capability: str):
    """The caller needs a capability; what a method calls in turn needs none of its own."""

    def wrap(method):
        @functools.wraps(method)
        def run(self, *args, **kwargs):
            with self._as(capability):
                return method(self, *args, **kwargs)

        return run

    return wrap


def _published(capability: str):
    """As _needs; and what the method changes is published as one state when it ends, or not at all."""

    def wrap(method):
        @functools.wraps(method)
        def run(self, *args, **kwargs):
            with self._as(capability), self._change():
                return method(self, *args, **kwargs)

        return run

    return wrap


def _copied(state: dict) -> dict:
    out = {k: copy.deepcopy(v) for k, v in state.items() if k not in ("commits", "tables")}
    out["commits"] = dict(state["commits"])
    out["tables"] = {n: {**copy.deepcopy({k: v for k, v in t.items() if k != "files"}), "files": list(t["files"])} for n, t in state["tables"].items()}
    return out


class Repository:
    """wrapping_key (32 bytes, kept elsewhere) wraps the keys of sealed columns; principal is who the caller is."""

    def __init__(self, spark: SparkSession, path: str, clock=None, wrapping_key: bytes | None = None, principal: str | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.store = ControlStore(spark, self.path)
        self.clock = clock or (lambda: time.time_ns() // 1000)
        self.wrapping_key, self.principal = wrapping_key, principal
        self.metrics = Metrics()
        self._depth, self._changing = 0, False
        self._made: list[str] = []
        self._doomed: list[str] = []
        self.version, self.state = self.store.load()

    @contextmanager
    def _as(self, capability: str):
        if self._depth == 0 and self.state.get("grants"):
            Access.of(self.state).require(self.principal or "", capability)
        self._depth += 1
        try:
            yield
        finally:
            self._depth -= 1

    @contextmanager
    def _change(self):
        """What is done inside is published as one state. On any exception nothing is, and folders written go."""
        if self._changing:
            yield
            return
        before, self.state, self._changing = self.state, _copied(self.state), True
        self._made, self._doomed = [], []
        try:
            yield
            self.version = self.store.publish(self.version, self.state)
        except BaseException as e:
            self.state = before
            for path in self._made:
                self.store.delete(path)
            if isinstance(e, Conflict):
                self.refresh()
            raise
        finally:
            self._changing = False
        live = {f["path"] for t in self.state["tables"].values() for f in t["files"]} | set(self.state["key_files"])
        for path in set(self._doomed) - live:
            self.store.delete(path)

    def _folder(self, *parts: str) -> str:
        """The name of a new folder, which goes again where the change is not published."""
        self._made.append("/".join([*parts, uuid.uuid4().hex]))
        return self._made[-1]

    # Creation and control state

    @classmethod
    def create(cls, spark: SparkSession, path: str, name: str, author: str, clock=None, **options) -> Repository:
        """An empty repository whose root commit, seq 0, is on the protected branch main."""
        if not author:
            raise Refused("an author is required")
        now = (clock or (lambda: time.time_ns() // 1000))()
        repo_id, main = uuid.uuid4().hex, uuid.uuid4().hex
        state = {"repo": {"id": repo_id, "name": name, "author": author, "created": now}, "branches": {}, "tags": {}, "commits": {}, "tables": {}, "sessions": {}, "proposals": {}, "plans": {}, "key_files": [], "purges": [], "drift": [], "once": {}, "deleted": {}, "grants": {}, "keys": {}}
        chain = [[main, 0]]
        root = encoding.commit_id(bytes.fromhex(repo_id), [], encoding.fold([]), encoding.fold([]), author, now, "root", "").hex()
        state["commits"][root] = {"id": root, "parents": [], "branch": main, "seq": 0, "author": author, "at": now, "message": "root", "external": "", "change": encoding.fold([]).hex(), "schema": encoding.fold([]).hex(), "integrity": "full", "chain": chain, "table": None}
        state["branches"]["main"] = {"id": main, "head": root, "seq": 0, "parent": None, "fork": None, "fork_seq": 0, "chain": chain, "protected": True, "min_approvals": 0}
        ControlStore(spark, path).publish(0, state)
        return cls(spark, path, clock, **options)

    @classmethod
    def open(cls, spark: SparkSession, path: str, clock=None, key: str | None = None, **options) -> Repository:
        """key is a principal's own, as grant recorded it; without one the principal is taken as named."""
        repo = cls(spark, path, clock, **options)
        if key is not None:
            repo.principal = Access.of(repo.state).principal(key)
        return repo

    @_published("admin")
    def grant(self, principal: str, *capabilities: str, key: str | None = None) -> None:
        """From the first grant on, every call needs its capability. So the first must name an administrator."""
        access = Access.of(self.state)
        access.grant(principal, *capabilities, key=key)
        if not any("admin" in held for held in access.grants.values()):
            raise Refused("the first grant must name an administrator")
        access.put(self.state)

    def refresh(self) -> None:
        self.version, self.state = self.store.load()

    def _branch(self, name: str) -> dict:
        if name not in self.state["branches"]:
            raise NotFound(f"branch {name}")
        return self.state["branches"][name]

    def _table(self, name: str) -> dict:
        if name not in self.state["tables"]:
            raise NotFound(f"table {name}")
        return self.state["tables"][name]

    def _find(self, ref: str) -> str:
        """A commit id from a commit, its unique prefix, a branch or a tag."""
        if ref in self.state["commits"]:
            return ref
        if ref in self.state["branches"]:
            return self.state["branches"][ref]["head"]
        if ref in self.state["tags"]:
            return self.state["tags"][ref]["commit"]
        found = [c for c in self.state["commits"] if c.startswith(ref)] if len(ref) >= 6 else []
        if len(found) != 1:
            raise NotFound(f"commit {ref}")
        return found[0]

    # Tables and their logs

    @_published("admin")
    def track(self, name: str, df: DataFrame, pk: list[str], mode: str = "versioned", unique: list[list[str]] = (), write_mode: str = "open") -> None:
        """Registers a table and backfills its rows as inserts at main's head."""
        if name in self.state["tables"]:
            raise Refused(f"{name} is tracked")
        if not pk:
            raise Refused(f"{name} has no primary key")
        found = introspect(df)
        names = [c["name"] for c in found]
        if missing := [k for k in pk if k not in names]:
            raise Refused(f"{name} has no column {missing[0]}")
        refused = [c["name"] for c in found if c["kind"] is None]
        if refused and mode == "versioned":
            raise UnsupportedType(f"{name}.{refused[0]} has a type that versioned tracking does not hold")
        ch.check_keys(df, pk)
        columns = [{"id": c["id"], "name": c["name"], "type": c["type"], "nullable": c["nullable"] and c["name"] not in pk} for c in found]
        table = {"id": len(self.state["tables"]) + 1, "mode": mode, "pk": [c["id"] for c in columns if c["name"] in pk], "unique": [list(u) for u in unique], "files": [], "write_mode": write_mode, "pii": {}, "schemas": {"": {"epoch": 0, "columns": columns, "dropped": []}}}
        table["pk"] = [next(c["id"] for c in columns if c["name"] == k) for k in pk]
        self.state["tables"][name] = table
        main = self._branch("main")
        rows = df.select(F.lit(INSERT).alias("op"), F.array().cast("array<int>").alias("changed"), *names)
        self._write(name, rows, main["id"], main["seq"], None, sc_version(table, ""))

    @_published("admin")
    def untrack(self, name: str, force: bool = False) -> None:
        """Drops a table's history; refused while a branch holds versions of its own, unless forced."""
        table = self._table(name)
        main = self._branch("main")["id"]
        if not force and any(f["branch"] != main for f in table["files"]):
            raise Refused(f"{name} has changes on branches")
        del self.state["tables"][name]
        self._doomed += [f["path"] for f in table["files"]]

    @_needs("read")
    def tables(self) -> DataFrame:
        rows = [(n, t["mode"], t["id"], len(sc_version(t, "").columns)) for n, t in sorted(self.state["tables"].items())]
        return self.spark.createDataFrame(rows, "table string, mode string, table_id int, columns int")

    @_needs("read")
    def schema(self, table: str, branch: str = "main") -> sc.Version:
        """The branch's newest schema, else the nearest along its chain, else the one at tracking."""
        t = self._table(table)
        for b, _ in self._branch(branch)["chain"]:
            if b in t["schemas"]:
                return sc_version(t, b)
        return sc_version(t, "")

    def _schema_at(self, table: str, chain: Chain) -> sc.Version:
        t = self._table(table)
        for b, s in chain:
            history = [x for x in [*t.get("epochs", {}).get(b, [])] if x["seq"] <= s]
            if history:
                return _version(history[-1], t["pk"])
        return sc_version(t, "")

    def _write(self, name: str, rows: DataFrame, branch: str, seq: int, session: str | None, version: sc.Version) -> str:
        """A new data folder of versions, sorted by key within files so that row groups can be skipped."""
        table = self._table(name)
        relative = self._folder("data", name)
        keys = [version.column(i).name for i in table["pk"]]
        ready = self._with_keys(name, rows, version, new=True).sortWithinPartitions(*keys).select(
            F.lit(branch).alias("branch_id"), F.lit(seq).cast("long").alias("seq_from"), F.col("op").cast("int").alias("op"), F.lit(session).cast("string").alias("session_id"), F.col("changed"),
            *[self._sealed(name, c, version).cast(c.type).alias(f"c_{c.id}") for c in version.columns],
        )
        ready.write.parquet(f"{self.path}/{relative}")
        table["files"].append({"path": relative, "branch": branch, "seq": seq, "session": session, "order": len(table["files"]), "columns": [[c.id, c.type] for c in version.columns]})
        return relative

    @_needs("read")
    def log(self, table: str, chain: Chain | None = None, session: str | None = None, version: sc.Version | None = None, among: list[dict] | None = None) -> DataFrame:
        """The version log under live column names: the files of a chain (all without one), each read by its own schema."""
        t = self._table(table)
        version = version or sc_version(t, "")
        top = {}
        for b, s in chain or []:
            top[b] = max(s, top.get(b, -1))
        files = [f for f in (t["files"] if among is None else among) if chain is None or (f["session"] is None and f["branch"] in top and f["seq"] <= top[f["branch"]]) or (session is not None and f["session"] == session)]
        groups: dict[tuple, list[str]] = {}
        for f in files:
            paths = groups.setdefault(tuple(map(tuple, f["columns"])), [])
            if (path := f"{self.path}/{f['path']}") not in paths:  # rewritten folders hold several branches
                paths.append(path)
        frames = []
        for columns, paths in groups.items():
            have = dict(columns)
            kinds = T.StructType([*META.fields, *[T.StructField(f"c_{i}", _parse(k)) for i, k in columns]])
            df = self.spark.read.schema(kinds).parquet(*paths)
            frames.append(df.select(*[x.name for x in META.fields], *[(F.col(f"c_{c.id}").cast(c.type) if c.id in have else F.lit(None).cast(c.type)).alias(c.name) for c in version.columns]))
        if not frames:
            return self.spark.createDataFrame([], T.StructType([*META.fields, *[T.StructField(c.name, _parse(c.type)) for c in version.columns]]))
        return self._opened(table, reduce(DataFrame.unionByName, frames), version)

    def _keys(self, table: str, version: sc.Version) -> list[str]:
        return [version.column(i).name for i in self._table(table)["pk"]]

    # Reads

    def _chain(self, branch: str, at: str | None, as_of: int | None) -> Chain:
        if at is not None:
            return [tuple(x) for x in self.state["commits"][self._find(at)]["chain"]]
        b = self._branch(branch)
        if as_of is not None:
            found = [c for c in self.state["commits"].values() if c["branch"] == b["id"] and c["at"] <= as_of]
            if not found:
                raise NotFound(f"{branch} has no commit at or before {as_of}")
            return [tuple(x) for x in max(found, key=lambda c: c["seq"])["chain"]]
        return [tuple(x) for x in b["chain"]]

    @_needs("read")
    def read(self, table: str, branch: str = "main", at: str | None = None, as_of: int | None = None, session: str | None = None, where: Predicate | None = None, after: dict | None = None, limit: int | None = None) -> DataFrame:
        """The rows of a branch, a commit (at), a moment in microseconds (as_of) or a session, by that schema."""
        if session is not None:
            s = self._session(session)
            chain = [tuple(x) for x in self.state["commits"][s["base"]]["chain"]]
        else:
            chain = self._chain(branch, at, as_of)
            self._refuse_dropped(table, chain)
        self.metrics.read(len(chain))
        version = self._schema_at(table, chain)
        return resolve(self.log(table, chain, session, version), chain, self._keys(table, version), session, where, after, limit).drop("changed")

    @_needs("read")
    def get(self, table: str, key: dict[str, Any], **where: Any) -> dict:
        from tidemark.functions.predicates import key_predicate

        rows = self.read(table, where=key_predicate(key), **where).limit(1).collect()
        if not rows:
            raise NotFound(f"{table} has no row {key}")
        return rows[0].asDict()

    @_needs("read")
    def commits(self, branch: str | None = None) -> DataFrame:
        keep = None if branch is None else self._branch(branch)["id"]
        rows = [(i, c["branch"], c["seq"], c["author"], c["at"], c["message"], c["parents"], c["external"], c["integrity"]) for i, c in self.state["commits"].items() if keep in (None, c["branch"])]
        df = self.spark.createDataFrame(rows, "commit_id string, branch_id string, seq long, author string, at long, message string, parents array<string>, external_ref string, integrity string")
        return df.withColumn("committed_at", F.timestamp_micros("at")).drop("at")

    @_needs("read")
    def history_log(self, branch: str = "main", limit: int = 20) -> DataFrame:
        """A branch's own commits, newest first; seqs do not tie."""
        return self.commits(branch).orderBy(F.col("seq").desc()).limit(limit)

    @_needs("read")
    def history(self, table: str, branch: str = "main", keys: DataFrame | None = None, inherited: bool = False) -> DataFrame:
        chain = self._chain(branch, None, None)
        version = self._schema_at(table, chain)
        log = self.log(table, chain, None, version)
        pk = self._keys(table, version)
        out = hi.history(log if keys is None else log.join(keys.select(*pk), pk, "left_semi"), self.commits(), chain, pk, inherited)
        return out.orderBy(*pk, F.col("seq_from").desc())

    @_needs("read")
    def blame(self, table: str, branch: str = "main", keys: DataFrame | None = None, columns: list[str] | None = None, inherited: bool = False) -> DataFrame:
        """Per key and column: the commit that gave the present value."""
        chain = self._chain(branch, None, None)
        version = self._schema_at(table, chain)
        pk = self._keys(table, version)
        seen = hi.history(self.log(table, chain, None, version), self.commits(), chain, pk, inherited)
        if keys is not None:
            seen = seen.join(keys.select(*pk), pk, "left_semi")
        names = columns or [c.name for c in version.columns if c.name not in pk]
        depth = F.create_map(*[x for i, (b, _) in enumerate(chain) for x in (F.lit(b), F.lit(len(chain) - i))])
        found = hi.blame(seen.withColumn("depth", depth[F.col("branch_id")]), pk, names, ["depth", "seq_from"])
        owner = F.create_map(*[x for i, (b, _) in enumerate(chain) for x in (F.lit(len(chain) - i), F.lit(b))])
        notes = self.commits().select("branch_id", F.col("seq").alias("seq_from"), "commit_id", "author", "committed_at", "message")
        return found.withColumn("branch_id", owner[F.col("depth")]).join(notes, ["branch_id", "seq_from"], "left").drop("depth")

    @_needs("read")
    def diff(self, table: str, branch: str = "main", from_seq: int = 0, to_seq: int = -1) -> DataFrame:
        b = self._branch(branch)
        to_seq = b["seq"] if to_seq < 0 else to_seq
        chain = [tuple(x) for x in b["chain"]]
        chain[0] = (chain[0][0], to_seq)
        self._refuse_dropped(table, [(b["id"], from_seq), (b["id"], to_seq)])
        version = self._schema_at(table, chain)
        return hi.diff(self.log(table, chain, None, version), chain, from_seq, to_seq, self._keys(table, version), _columns(version))

    @_needs("read")
    def diff_commits(self, table: str, before: str, after: str) -> DataFrame:
        """Net changes between any two commits, branches or tags."""
        a, b = self._chain("main", before, None), self._chain("main", after, None)
        self._refuse_dropped(table, [*a, *b])
        version = self._schema_at(table, b)
        pk = self._keys(table, version)
        return hi.compare(resolve(self.log(table, a, None, version), a, pk), resolve(self.log(table, b, None, version), b, pk), pk, _columns(version))

    # Commits

    @_published("write")
    def commit(self, table: str, changes: DataFrame, branch: str = "main", author: str = "", message: str = "", ref: str = "", expected_head: str | None = None, idempotency_key: str | None = None, extra_parents: list[str] = (), at: int | None = None) -> CommitResult:
        """Applies changes (columns, optional op: 1 insert, 2 update, 3 delete) to a branch as one commit.

        Without op every row is a write. A commit of no-ops alone advances the head and changes nothing. All
        rows become visible by one published state, or none do.
        """
        began = time.monotonic()
        if not author:
            raise Refused("an author is required")
        if idempotency_key and idempotency_key in self.state["once"]:
            return CommitResult(**self.state["once"][idempotency_key])
        b = self._branch(branch)
        if expected_head is not None and b["head"] != expected_head:
            raise Conflict(f"{branch} is at {b['head']}")
        t = self._table(table)
        version = self.schema(table, branch)
        pk = self._keys(table, version)
        names = [c.name for c in version.columns]
        rows = changes if "op" in changes.columns else changes.withColumn("op", F.lit(INSERT))
        kinds = {c.name: c.type for c in version.columns}
        rows = rows.select(F.col("op").cast("int").alias("op"), *[(F.col(n).cast(kinds[n]) if n in rows.columns else F.lit(None).cast(kinds[n])).alias(n) for n in names])
        ch.check_keys(rows, pk)
        chain = [tuple(x) for x in b["chain"]]
        current = resolve(self.log(table, chain, None, version), chain, pk).drop("changed")
        seq = b["seq"] + 1
        ready = ch.normalise(rows, current, pk, _columns(version))
        path = self._write(table, ready, b["id"], seq, None, version)
        written = self.spark.read.schema(self._file_schema(version)).parquet(f"{self.path}/{path}")
        changed = written.count()
        digest = self._change_digest(table, written, version) if changed else encoding.fold([])
        if not changed:
            self._doomed.append(t["files"].pop()["path"])
        result = self._append(table, branch, version, seq, digest, [b["head"], *extra_parents], author, message, ref, changed, at)
        if idempotency_key:
            self.state["once"][idempotency_key] = result.__dict__
        self.metrics.commit(changed, time.monotonic() - began)
        return result

    def _file_schema(self, version: sc.Version) -> T.StructType:
        return T.StructType([*META.fields, *[T.StructField(f"c_{c.id}", _parse(c.type)) for c in version.columns]])

    def _change_digest(self, table: str, written: DataFrame, version: sc.Version) -> bytes:
        t = self._table(table)
        plain = self._opened(table, written.select(*[x.name for x in META.fields], *[F.col(f"c_{c.id}").alias(c.name) for c in version.columns]), version)
        typed = {c.id: (F.col(c.name), _parse(c.type)) for c in version.columns}
        leaf = encoding.leaf_digest(t["id"], F.col("op"), F.col("changed"), [typed[i] for i in t["pk"]], [(c.id, *typed[c.id]) for c in version.columns])
        return encoding.merkle_root(plain.select(leaf.alias("leaf")))

    def _append(self, table: str, branch: str, version: sc.Version, seq: int, digest: bytes, parents: list[str], author: str, message: str, ref: str, changed: int, at: int | None = None) -> CommitResult:
        t, b = self._table(table), self._branch(branch)
        shape = encoding.schema_digest(t["id"], [(c.id, c.name, c.type, c.nullable, c.id in t["pk"]) for c in version.columns])
        now = self.clock() if at is None else at
        commit = encoding.commit_id(bytes.fromhex(self.state["repo"]["id"]), [bytes.fromhex(p) for p in parents], digest, shape, author, now, message, ref).hex()
        chain = [[b["id"], seq], *b["chain"][1:]]
        self.state["commits"][commit] = {"id": commit, "parents": list(parents), "branch": b["id"], "seq": seq, "author": author, "at": now, "message": message, "external": ref, "change": digest.hex(), "schema": shape.hex(), "integrity": "full", "chain": chain, "table": table}
        b.update(head=commit, seq=seq, chain=chain)
        return CommitResult(commit, seq, changed)

    @_published("write")
    def update_where(self, table: str, where: Predicate | None, assignments: dict[str, Any], branch: str = "main", author: str = "", message: str = "") -> CommitResult:
        return self.commit(table, ch.update_where(self.read(table, branch), where, assignments), branch, author, message)

    @_published("write")
    def delete_where(self, table: str, where: Predicate | None, branch: str = "main", author: str = "", message: str = "") -> CommitResult:
        keys = ch.delete_where(self.read(table, branch), where, self._keys(table, self.schema(table, branch)))
        return self.commit(table, keys.withColumn("op", F.lit(DELETE)), branch, author, message)

    @_published("write")
    def revert(self, table: str, commit: str, branch: str = "main", author: str = "", message: str = "", force: bool = False) -> CommitResult:
        """Undoes one commit of the branch; refused where a key changed again later, unless forced."""
        commit = self._find(commit)
        c, b = self.state["commits"][commit], self._branch(branch)
        if not c["parents"]:
            raise Refused("the root commit cannot be reverted")
        if c["branch"] != b["id"]:
            raise Refused(f"{commit[:12]} is not a commit of {branch}")
        undo = self.diff(table, branch, c["seq"] - 1, c["seq"])
        version = self.schema(table, branch)
        pk = self._keys(table, version)
        if not force:
            later = hi.touched_later(self.log(table, [tuple(x) for x in b["chain"]], None, version), b["id"], c["seq"], undo, pk).limit(1).collect()
            if later:
                raise Refused(f"key {[later[0][k] for k in pk]} changed after {commit[:12]}")
        return self.commit(table, hi.inverse(undo, pk, _columns(version)), branch, author, message or f"Revert {commit[:12]}", ref=f"revert:{commit}")

    # Refs

    @_published("branch")
    def branch(self, name: str, source: str = "main") -> None:
        if name in self.state["branches"] or name in self.state["tags"]:
            raise Refused(f"{name} exists")
        p = self._branch(source)
        new = uuid.uuid4().hex
        chain = child_chain(new, p["id"], p["seq"], [tuple(x) for x in p["chain"]])
        self.state["branches"][name] = {"id": new, "head": p["head"], "seq": 0, "parent": source, "fork": p["head"], "fork_seq": p["seq"], "chain": [list(x) for x in chain], "protected": False, "min_approvals": 0}

    @_published("branch")
    def delete_branch(self, name: str) -> None:
        b = self._branch(name)
        if name == "main":
            raise Refused("main stays")
        if any(x["parent"] == name for x in self.state["branches"].values()):
            raise Refused(f"{name} has child branches")
        self.state["deleted"][b["id"]] = self.clock()
        del self.state["branches"][name]

    @_published("branch")
    def tag(self, name: str, at: str) -> None:
        if name in self.state["branches"] or name in self.state["tags"]:
            raise Refused(f"{name} exists")
        commit = self._find(at)
        self.state["tags"][name] = {"commit": commit, "chain": self.state["commits"][commit]["chain"]}

    @_needs("read")
    def refs(self) -> DataFrame:
        rows = [("branch", n, b["head"], b["seq"], b["parent"], b["protected"], b["min_approvals"]) for n, b in self.state["branches"].items()]
        rows += [("tag", n, t["commit"], self.state["commits"][t["commit"]]["seq"], None, True, 0) for n, t in self.state["tags"].items()]
        return self.spark.createDataFrame(sorted(rows, key=lambda r: r[:2]), "kind string, name string, head string, seq long, parent string, protected boolean, min_approvals int")

    @_published("admin")
    def protect(self, name: str, protected: bool = True, min_approvals: int = 1) -> None:
        self._branch(name).update(protected=protected, min_approvals=min_approvals)

    # Merges

    @_needs("read")
    def merge_base(self, a: str, b: str) -> list[str]:
        """All common ancestors that are no ancestors of another one, in time linear in the commits; a commit that is not there ends the walk."""
        commits = self.state["commits"]

        def ancestors(*start: str) -> set[str]:
            seen, todo = set(), list(start)
            while todo:
                c = todo.pop()
                if c not in seen and c in commits:
                    seen.add(c)
                    todo += commits[c]["parents"]
            return seen

        common = ancestors(self._find(a)) & ancestors(self._find(b))
        return sorted(common - ancestors(*[p for c in common for p in commits[c]["parents"]]))

    @_needs("read")
    def refs_with_parents(self) -> DataFrame:
        """kind, name, parent and the parent's head, for those without a parent too."""
        refs = self.refs()
        heads = refs.where("kind = 'branch'").select(F.col("name").alias("parent"), F.col("head").alias("parent_head"))
        return refs.select("kind", "name", "parent").join(heads, "parent", "left")

    def pinned(self, branch_id: str) -> set[int]:
        """Seqs of a branch that any branch, tag or open session stands on: their states are kept."""
        chains = [b["chain"] for b in self.state["branches"].values()] + [t["chain"] for t in self.state["tags"].values()]
        chains += [self.state["commits"][x["base"]]["chain"] for x in self.state["sessions"].values() if x["state"] == "open"]
        return {q for c in chains for b, q in c if b == branch_id}

    def _judged(self, table: str, base: Chain, ours: Chain, theirs: Chain, version: sc.Version) -> tuple[DataFrame, list[str], list[str]]:
        self._refuse_dropped(table, base)
        pk = self._keys(table, version)
        values = [c.name for c in version.columns if c.name not in pk]
        whole = [*base, *ours, *theirs]
        return mg.judge(mg.three_way_scan(self.log(table, whole, None, version), base, ours, theirs, pk, values), pk, values), pk, values

    @_published("merge")
    def merge(self, table: str, source: str, target: str, author: str = "", message: str = "", apply: bool = True, limit: int | None = MERGE_LIMIT, chunked: bool = False, choices: DataFrame | None = None, base: str | None = None) -> MergeResult:
        """Merges source into target against their one merge base. Any conflict or violation applies nothing.

        Changes are in the order of their keys, conflicts in that of key, kind and column.
        More than limit changed rows are refused unless chunked; the publication is one step either way.
        """
        if base is None:
            found = self.merge_base(source, target)
            if len(found) != 1:
                raise Refused(f"{len(found)} merge bases: {', '.join(x[:12] for x in found)}")
            base = found[0]
        version = self.schema(table, target)
        judged, pk, values = self._judged(table, self._chain("main", base, None), self._chain(target, None, None), self._chain(source, None, None), version)
        changes, conflicts = mg.merge_changes(judged, pk, values), mg.conflicts(judged, pk, values)
        if choices is not None:
            changes = changes.unionByName(mg.resolved(judged, pk, values, choices))
            conflicts = conflicts.join(choices.select(*pk, F.coalesce("column", F.lit("")).alias("__c")), [conflicts[k] == choices[k] for k in pk] + [F.coalesce(conflicts["column"], F.lit("")) == F.col("__c")], "left_anti")
        clean = conflicts.isEmpty()
        violations = self.validate(table, target, changes if clean else changes.limit(0))
        ordered = (changes.orderBy(*pk), conflicts.orderBy(*pk, "kind", "column"))
        result = MergeResult(clean and violations.isEmpty(), *ordered, violations)
        self.metrics.merge(result.clean)
        if apply and result.clean:
            if limit is not None and not chunked and changes.limit(limit + 1).count() > limit:
                raise Refused(f"more than {limit} rows change; pass chunked=True")
            done = self.commit(table, changes, target, author, message or f"Merge {source} into {target}", extra_parents=[self._branch(source)["head"]])
            result.commit = done.commit
        return result

    @_published("branch")
    def update_from_parent(self, table: str, branch: str, author: str = "") -> MergeResult | None:
        """Merges the parent's new commits into a branch, whose fork point and chain then move to the parent's head."""
        b = self._branch(branch)
        if b["parent"] is None:
            raise Refused("main has no parent")
        p = self._branch(b["parent"])
        if p["head"] == b["fork"]:
            return None
        chain = [[b["id"], b["seq"]], [p["id"], p["seq"]], *p["chain"][1:]]
        version = self.schema(table, branch)
        judged, pk, values = self._judged(table, self._chain("main", b["fork"], None), self._chain(branch, None, None), self._chain(b["parent"], None, None), version)
        changes, conflicts = mg.merge_changes(judged, pk, values), mg.conflicts(judged, pk, values)
        clean = conflicts.isEmpty()
        violations = self.validate(table, branch, changes if clean else changes.limit(0))
        result = MergeResult(clean and violations.isEmpty(), changes.orderBy(*pk), conflicts.orderBy(*pk, "kind", "column"), violations)
        if result.clean:
            result.commit = self.commit(table, changes, branch, author, f"Update from {b['parent']}", extra_parents=[p["head"]]).commit
            chain = [[b["id"], b["seq"]], *chain[1:]]
            b.update(fork=p["head"], fork_seq=p["seq"], chain=chain)
            self.state["commits"][result.commit] = {**self.state["commits"][result.commit], "chain": chain}
        return result

    @_needs("read")
    def validate(self, table: str, branch: str, changes: DataFrame) -> DataFrame:
        """What changes would break: rule (not_null or unique), columns, value (as text), rows.

        One row for each column that changed rows leave empty, and for each value of a unique list that a changed
        row would share. Only rows with a version that holds such a value are resolved.
        """
        t, version = self._table(table), self.schema(table, branch)
        pk = self._keys(table, version)
        chain = self._chain(branch, None, None)
        written = changes.where(F.col("op") != DELETE).select(*[c.name for c in version.columns])
        out = self.spark.createDataFrame([], "rule string, columns array<string>, value array<string>, rows long")
        if required := [c.name for c in version.columns if not c.nullable]:
            out = out.unionByName(ch.null_violations(written, required).select(F.lit("not_null").alias("rule"), F.array("column").alias("columns"), F.lit(None).cast("array<string>").alias("value"), F.col("n_rows").alias("rows")))
        log = self.log(table, chain, None, version)
        for columns in t["unique"]:
            given = written.select(*columns).dropna().distinct()
            keys = candidate_keys(log.join(given, columns, "left_semi"), chain, pk)
            held = resolve(log.join(keys, pk, "left_semi").select(*log.columns), chain, pk).select(*written.columns)
            after = held.join(changes.select(*pk), pk, "left_anti").unionByName(written)
            found = ch.unique_violations(after, columns, pk).join(given, columns, "left_semi")
            out = out.unionByName(found.select(F.lit("unique").alias("rule"), F.array(*[F.lit(c) for c in columns]).alias("columns"), F.array(*[F.col(c).cast("string") for c in columns]).alias("value"), F.col("n_rows").alias("rows")))
        return out

    # Sessions

    def _session(self, session: str) -> dict:
        s = self.state["sessions"].get(session)
        if not s or s["state"] != "open":
            raise NotFound(f"session {session}")
        if s["expires"] < self.clock():
            raise Refused(f"session {session} has expired")
        return s

    @_published("write")
    def open_session(self, branch: str, principal: str) -> str:
        """A private overlay on a branch other than main, leased for a day."""
        if branch == "main":
            raise Refused("sessions are for branches")
        session = uuid.uuid4().hex
        self.state["sessions"][session] = {"branch": branch, "principal": principal, "base": self._branch(branch)["head"], "state": "open", "expires": self.clock() + LEASE_S * 1_000_000, "tables": []}
        return session

    @_published("write")
    def session_write(self, session: str, table: str, changes: DataFrame) -> None:
        """Stages changes; staging a key again replaces what it staged. Renews the lease."""
        s = self._session(session)
        version = self.schema(table, s["branch"])
        pk, names = self._keys(table, version), [c.name for c in version.columns]
        kinds = {c.name: c.type for c in version.columns}
        rows = changes if "op" in changes.columns else changes.withColumn("op", F.lit(INSERT))
        rows = rows.select(F.col("op").cast("int").alias("op"), F.array().cast("array<int>").alias("changed"), *[(F.col(n).cast(kinds[n]) if n in rows.columns else F.lit(None).cast(kinds[n])).alias(n) for n in names])
        ch.check_keys(rows, pk)
        stage = s.get("writes", 0) + 1
        self._write(table, rows, self._branch(s["branch"])["id"], stage, session, version)
        s.update(writes=stage, expires=self.clock() + LEASE_S * 1_000_000, tables=sorted({*s["tables"], table}))

    @_published("write")
    def commit_session(self, session: str, table: str, author: str, message: str = "") -> CommitResult:
        s = self._session(session)
        if self._branch(s["branch"])["head"] != s["base"]:
            raise Conflict(f"{s['branch']} moved since the session opened")
        version = self.schema(table, s["branch"])
        chain = [tuple(x) for x in self.state["commits"][s["base"]]["chain"]]
        log = self.log(table, chain, session, version)
        staged = winners(log.where(F.col("session_id") == session), chain, self._keys(table, version), session)
        result = self.commit(table, staged.select("op", *[c.name for c in version.columns]), s["branch"], author, message, expected_head=s["base"])
        self._end(session, "committed")
        return result

    @_published("write")
    def abandon_session(self, session: str) -> None:
        self._end(session, "abandoned")

    def _end(self, session: str, state: str) -> None:
        self.state["sessions"][session]["state"] = state
        for t in self.state["tables"].values():
            t["files"] = [f for f in t["files"] if f["session"] != session]

    @_published("write")
    def reap_sessions(self) -> int:
        old = [i for i, s in self.state["sessions"].items() if s["state"] == "open" and s["expires"] < self.clock()]
        for i in old:
            self._end(i, "expired")
        return len(old)

    # Proposals

    @_published("branch")
    def propose(self, source: str, target: str, title: str, author: str, description: str = "") -> int:
        self._branch(source), self._branch(target)
        number = len(self.state["proposals"]) + 1
        self.state["proposals"][str(number)] = {"source": source, "target": target, "title": title, "description": description, "author": author, "state": "open", "reviews": [], "conflicts": [], "at": self.clock()}
        return number

    @_published("approve")
    def review(self, proposal: int, kind: str, principal: str, body: str = "") -> None:
        """kind: approve, request_changes or comment. Own approvals do not count on a protected target."""
        p = self._proposal(proposal)
        if kind not in ("approve", "request_changes", "comment"):
            raise ValueError(kind)
        if kind == "approve" and principal == p["author"] and self._branch(p["target"])["protected"]:
            raise Refused("authors cannot approve their own proposal")
        p["reviews"].append({"kind": kind, "by": principal, "body": body, "at": self.clock()})
        latest = {r["by"]: r["kind"] for r in p["reviews"] if r["kind"] != "comment"}
        approvals = {who for who, k in latest.items() if k == "approve" and who != p["author"]}
        if p["state"] in ("open", "approved"):
            p["state"] = "approved" if "request_changes" not in latest.values() and len(approvals) >= max(1, self._branch(p["target"])["min_approvals"]) else "open"

    def _proposal(self, number: int) -> dict:
        if str(number) not in self.state["proposals"]:
            raise NotFound(f"proposal {number}")
        return self.state["proposals"][str(number)]

    @_published("branch")
    def close_proposal(self, number: int) -> None:
        self._proposal(number)["state"] = "closed"

    @_published("merge")
    def resolve_conflict(self, proposal: int, key: dict[str, Any], choice: str, column: str | None = None, value: Any = None, principal: str = "") -> None:
        """Records ours, theirs, base or value for a conflict; the next merge of the proposal applies it."""
        if choice not in ("ours", "theirs", "base", "value"):
            raise ValueError(choice)
        p = self._proposal(proposal)
        p["conflicts"] = [c for c in p["conflicts"] if (c["key"], c["column"]) != (key, column)]
        p["conflicts"].append({"key": key, "column": column, "choice": choice, "value": None if value is None else str(value), "by": principal})

    @_needs("merge")
    def merge_proposal(self, number: int, table: str, principal: str, chunked: bool = False) -> MergeResult:
        """Gates, then the schema merge, then the data merge with recorded resolutions; chunked as in merge."""
        p = self._proposal(number)
        if p["state"] not in ("open", "approved", "conflicted"):
            raise Refused(f"proposal {number} is {p['state']}")
        target = self._branch(p["target"])
        latest = {r["by"]: r["kind"] for r in p["reviews"] if r["kind"] != "comment"}
        if "request_changes" in latest.values():
            raise Refused("changes were requested")
        approvals = {who for who, k in latest.items() if k == "approve" and who != p["author"]}
        if target["protected"] and len(approvals) < target["min_approvals"]:
            raise Refused(f"{len(approvals)} of {target['min_approvals']} approvals")
        merged = self.merge_schema(table, p["source"], p["target"], number)
        if merged["conflicts"]:
            self._mark(number, "conflicted")
            raise Refused(f"schemas conflict: {merged['conflicts']}")
        if merged["plan"] is not None:
            raise Refused(f"plan {merged['plan']} is to be applied first")
        choices = None
        if p["conflicts"]:
            version = self.schema(table, p["target"])
            pk = self._keys(table, version)
            kinds = ", ".join(f"`{k}` {version.named(k).type}" for k in pk)
            choices = self.spark.createDataFrame([(*[c["key"][k] for k in pk], c["column"], c["choice"], c["value"]) for c in p["conflicts"]], f"{kinds}, column string, choice string, value string")
        with self._change():
            result = self.merge(table, p["source"], p["target"], principal, p["title"], chunked=chunked, choices=choices)
            self._mark(number, "merged" if result.clean else "conflicted")
        return result

    def _mark(self, number: int, state: str) -> None:
        with self._change():
            self._proposal(number)["state"] = state

    @_needs("read")
    def proposals(self, *states: str) -> DataFrame:
        rows = [(int(n), p["source"], p["target"], p["title"], p["author"], p["state"], len(p["reviews"])) for n, p in self.state["proposals"].items() if not states or p["state"] in states]
        return self.spark.createDataFrame(sorted(rows, reverse=True), "proposal int, source string, target string, title string, author string, state string, reviews int")

    # Schemas

    @_published("branch")
    def alter_schema(self, table: str, branch: str, columns: list[tuple], author: str = "") -> sc.Version:
        """columns: (name, type, nullable) or (name, type, nullable, id). Not on main: that takes a plan."""
        if branch == "main":
            raise Refused("main changes by a migration plan")
        want = [sc.Column(c[3] if len(c) > 3 else 0, c[0], c[1], c[2]) for c in columns]
        version = sc.settle(self.schema(table, branch), want)
        if missing := [i for i in version.pk if version.column(i) is None]:
            raise Refused(f"key column {missing[0]} stays")
        self._put_schema(table, branch, version, author or self.state["repo"]["author"], f"Alter {table}")
        return version

    def _put_schema(self, table: str, branch: str, version: sc.Version, author: str, message: str) -> None:
        """A schema change is a commit without rows, so chains that stand before it keep the old schema."""
        t, b = self._table(table), self._branch(branch)
        entry = {"epoch": version.epoch, "columns": [c.__dict__ for c in version.columns], "dropped": list(version.dropped)}
        t["schemas"][b["id"]] = entry
        t.setdefault("epochs", {}).setdefault(b["id"], []).append({**entry, "seq": b["seq"] + 1})
        self._append(table, branch, version, b["seq"] + 1, encoding.fold([]), [b["head"]], author, message, "", 0)

    @_published("merge")
    def merge_schema(self, table: str, source: str, target: str, proposal: int | None = None) -> dict:
        """Three-way against the schema at the merge base; changes become a pending plan."""
        bases = self.merge_base(source, target)
        base = self._schema_at(table, self._chain("main", bases[0], None)) if len(bases) == 1 else sc_version(self._table(table), "")
        ours, theirs = self.schema(table, target), self.schema(table, source)
        out = sc.merge(base, ours, theirs)
        steps = sc.plan(sc.diff(ours, out.result)) if not out.conflicts else []
        if not steps:
            return {"plan": None, "conflicts": out.conflicts}
        number = len(self.state["plans"]) + 1
        self.state["plans"][str(number)] = {"table": table, "target": target, "proposal": proposal, "state": "pending", "done": [], "steps": [{"kind": s.kind, "level": int(s.level), "column": s.column.__dict__, "new_name": s.new_name} for s in steps], "epoch": ours.epoch}
        return {"plan": number, "conflicts": []}

    @_needs("read")
    def plans(self, *states: str) -> DataFrame:
        rows = [(int(n), p["table"], p["target"], p["state"], len(p["steps"]), len(p["done"])) for n, p in self.state["plans"].items() if not states or p["state"] in states]
        return self.spark.createDataFrame(sorted(rows, reverse=True), "plan int, table string, target string, state string, steps int, done int")

    @_needs("read")
    def plan_ddl(self, number: int, dialect: str = "spark") -> list[str]:
        """A plan's steps as statements, for a live table kept outside."""
        p = self.state["plans"][str(number)]
        return [x for q in p["steps"] for x in ddl.statements(p["table"], sc.Step(0, q["kind"], sc.Class(q["level"]), sc.Column(**q["column"]), q["new_name"]), dialect)]

    @_needs("merge")
    def apply_plan(self, number: int, confirm: bool = False, crash_after: int | None = None) -> sc.Version:
        """Runs a plan's steps, each recorded when done; a run that broke off goes on behind the last one."""
        p = self.state["plans"][str(number)]
        steps = [sc.Step(i, s["kind"], sc.Class(s["level"]), sc.Column(**s["column"]), s["new_name"]) for i, s in enumerate(p["steps"])]
        if (why := sc.confirmation(steps)) and not confirm:
            raise Refused("; ".join(why))
        for s in steps:
            if s.ordinal in self.state["plans"][str(number)]["done"]:
                continue
            if crash_after is not None and s.ordinal >= crash_after:
                raise RuntimeError("stopped")
            now = self.schema(p["table"], p["target"])
            columns = list(now.columns)
            at = next((i for i, c in enumerate(columns) if c.id == s.column.id), None)
            dropped = set(now.dropped)
            if s.kind == "preflight_not_null":
                if at is not None and ch.null_violations(self.read(p["table"], p["target"]), [columns[at].name]).count():
                    raise Refused(f"{columns[at].name} holds NULL")
            elif s.kind == "add_column" and at is None:
                columns.append(s.column)
            elif s.kind == "drop_column" and at is not None:
                columns.pop(at)
                dropped.add(s.column.id)
            elif s.kind == "rename_column" and at is not None:
                columns[at] = sc.replace(columns[at], name=s.new_name)
            elif s.kind in ("alter_type", "set_not_null", "drop_not_null") and at is not None:
                columns[at] = sc.replace(columns[at], type=s.column.type if s.kind == "alter_type" else columns[at].type, nullable={"set_not_null": False, "drop_not_null": True}.get(s.kind, columns[at].nullable))
            with self._change():
                if tuple(columns) != now.columns:
                    self._put_schema(p["table"], p["target"], sc.Version(tuple(columns), now.pk, tuple(sorted(dropped)), now.epoch + 1), self.state["repo"]["author"], f"Plan {number}: {s.kind}")
                self.state["plans"][str(number)]["done"].append(s.ordinal)
        with self._change():
            self.state["plans"][str(number)]["state"] = "applied"
        return self.schema(p["table"], p["target"])

    # Personal data

    @_published("admin")
    def designate_pii(self, table: str, column: str, subject: str) -> None:
        """Seals a text column under its subject's key, in history too. Key columns are refused."""
        t, version = self._table(table), sc_version(self._table(table), "")
        if self.wrapping_key is None or len(self.wrapping_key) != 32:
            raise Refused("sealing needs a wrapping key of 32 bytes")
        c = version.named(column)
        if c.id in t["pk"]:
            raise Refused("a key column cannot be sealed")
        log, old = self.log(table, None, None, version), t["files"]
        t["pii"][column] = subject
        self._rewrite(table, log, version)
        self._vacuum(old)

    def _key_table(self) -> DataFrame:
        """subject, key, as stored: wrapped. A forgotten key is NULL and its row stays, so that it is not made anew."""
        if not self.state["key_files"]:
            return self.spark.createDataFrame([], "subject string, key binary")
        return self.spark.read.schema("subject string, key binary").parquet(*[f"{self.path}/{f}" for f in self.state["key_files"]])

    def _put_keys(self, keys: DataFrame) -> str:
        relative = self._folder("keys")
        keys.write.parquet(f"{self.path}/{relative}")
        return relative

    def _new_keys(self, subjects: DataFrame) -> None:
        """A random key for each subject (column subject) that has none, written once before it is used."""

        def draw(batches):
            import secrets

            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([secrets.token_bytes(32) for _ in range(batch.num_rows)], pa.binary())], names=["subject", "key"])

        fresh = subjects.where("subject IS NOT NULL").distinct().join(self._key_table(), "subject", "left_anti")
        drawn = fresh.select("subject").mapInArrow(draw, "subject string, key binary")
        self.state["key_files"].append(self._put_keys(drawn.select("subject", privacy.wrap(F.col("key"), self.wrapping_key, F.col("subject")).alias("key"))))

    def _with_keys(self, name: str, rows: DataFrame, version: sc.Version, new: bool = False) -> DataFrame:
        """Adds the key of each sealed column's subject, by a join: subjects are as many as the data has."""
        subjects = sorted({s for c, s in self._table(name)["pii"].items() if version.named(c)})
        for s in subjects:
            if new:
                self._new_keys(rows.select(F.col(s).cast("string").alias("subject")))
            keys = self._key_table()
            if self.wrapping_key is not None:  # without it sealed values read as erased
                keys = keys.select("subject", privacy.unwrap(F.col("key"), self.wrapping_key, F.col("subject")).alias("key"))
            else:
                keys = keys.select("subject", F.lit(None).cast("binary").alias("key"))
            rows = privacy.with_keys(rows, keys, s).withColumnRenamed("__key", f"__key_{s}")
        return rows

    def _aad(self, name: str, column_id: int, version: sc.Version):
        return privacy.associated(name, F.concat_ws("|", *[F.col(k).cast("string") for k in self._keys(name, version)]), column_id)

    def _sealed(self, name: str, c: sc.Column, version: sc.Version):
        subject = self._table(name)["pii"].get(c.name)
        if subject is None:
            return F.col(c.name)
        sealed = privacy.seal(F.col(c.name), F.col(f"__key_{subject}"), self._aad(name, c.id, version))
        ownerless = F.col(c.name).isNotNull() & F.col(subject).isNull()
        return F.when(ownerless, F.raise_error(F.lit(f"{c.name} has a value but {subject} names no subject"))).otherwise(sealed)

    def _opened(self, name: str, df: DataFrame, version: sc.Version) -> DataFrame:
        pii = self._table(name)["pii"]
        opened = {c.name: privacy.unseal(F.col(c.name), F.col(f"__key_{pii[c.name]}"), self._aad(name, c.id, version)) for c in version.columns if c.name in pii}
        return self._with_keys(name, df, version).withColumns(opened).select(*df.columns) if opened else df

    def _vacuum(self, old: list[dict]) -> None:
        """Folders that the next published state no longer names go with it. Frames read from them before fail."""
        self._doomed += [f["path"] for f in old]

    @_published("purge")
    def erase_subject(self, table: str, subject: str, author: str, reason: str = "") -> CommitResult:
        """Deletes the subject's current rows by a commit, then forgets the key: history reads as erased."""
        columns = set(self._table(table)["pii"].values())
        if not columns:
            raise Refused(f"{table} has no sealed column")
        mine = reduce(lambda a, b: a | b, [F.col(c).cast("string") == subject for c in columns])
        keys = self.read(table).where(mine).select(*self._keys(table, self.schema(table)))
        result = self.commit(table, keys.withColumn("op", F.lit(DELETE)), "main", author, f"Erase subject: {reason}")
        old = self.state["key_files"]
        forgotten = self._key_table().withColumn("key", F.when(F.col("subject") != subject, F.col("key")))
        self.state["key_files"] = [self._put_keys(forgotten)]
        self._doomed += old
        return result

    # Retention and checks

    def _rewrite(self, table: str, rows: DataFrame, version: sc.Version, owners: list[tuple] | None = None, others: list[dict] = ()) -> None:
        """Puts rows into one folder in place of a table's files but others; owners are the branches and sessions in it."""
        t = self._table(table)
        owners = sorted({(f["branch"], f["session"]) for f in t["files"]}, key=str) if owners is None else owners
        t["files"] = list(others)
        rows = rows.select(*[x.name for x in META.fields], *[c.name for c in version.columns])
        relative = self._folder("data", table)
        ready = self._with_keys(table, rows, version, new=True).select(*[x.name for x in META.fields], *[self._sealed(table, c, version).cast(c.type).alias(f"c_{c.id}") for c in version.columns])
        ready.repartition(*[F.col(f"c_{i}") for i in t["pk"]]).sortWithinPartitions("branch_id", *[f"c_{i}" for i in t["pk"]], "seq_from").write.parquet(f"{self.path}/{relative}")
        for branch, session in owners:
            t["files"].append({"path": relative, "branch": branch, "seq": 0, "session": session, "order": 0, "columns": [[c.id, c.type] for c in version.columns], "shared": True})

    @_published("admin")
    def compact(self, table: str) -> None:
        """Rewrites a table's small files into one sorted folder."""
        wide, old = self._widest(table), self._table(table)["files"]
        self._rewrite(table, self.log(table, None, None, wide), wide)
        self._vacuum(old)

    def _widest(self, table: str) -> sc.Version:
        """Every column that any file holds."""
        t = self._table(table)
        known: dict[int, sc.Column] = {}
        for entry in [t["schemas"][""], *[e for es in t.get("epochs", {}).values() for e in es], *t["schemas"].values()]:
            for c in entry["columns"]:
                known[c["id"]] = sc.Column(**c)
        return sc.Version(tuple(known[i] for i in sorted(known)), tuple(t["pk"]))

    @_published("admin")
    def prune(self, table: str, keep_days: int | None = None, keep_commits: int | None = None) -> int:
        """Drops old closed versions of main; seqs that any chain, tag or session stands on are kept whole."""
        main = self._branch("main")
        own = [c for c in self.state["commits"].values() if c["branch"] == main["id"]]
        cutoff = retention.prune_cutoff(own, self.clock(), keep_days, keep_commits, sorted(self.pinned(main["id"])))
        version = self._widest(table)
        pk = self._keys(table, version)
        log = self.log(table, None, None, version)
        gone = retention.prune_report(log, main["id"], cutoff, pk).agg(F.sum("removed")).first()[0] or 0
        if gone:
            old = self._table(table)["files"]
            self._rewrite(table, retention.prune(log, main["id"], cutoff, pk), version)
            self._thin(table, main["id"], 0, cutoff + 1)
            self._vacuum(old)
        return gone

    @_published("admin")
    def gc(self, grace_s: int = 0) -> int:
        """Reaps sessions and drops files of branches deleted longer ago than the grace period."""
        self.reap_sessions()
        gone = {b for b, at in self.state["deleted"].items() if at <= self.clock() - grace_s * 1_000_000}
        n = 0
        for name, t in self.state["tables"].items():
            dead = [f for f in t["files"] if f["branch"] in gone]
            n += len(dead)
            t["files"] = [f for f in t["files"] if f["branch"] not in gone]
            self._vacuum(dead)
        for b in gone:
            del self.state["deleted"][b]
        return n

    @_published("purge")
    def purge(self, table: str, keys: DataFrame, reason: str, principal: str) -> int:
        """Removes every version of keys everywhere and marks the commits that held them. A reason is required."""
        if not reason.strip():
            raise Refused("a purge needs a reason")
        version = self._widest(table)
        pk = self._keys(table, version)
        log = self.log(table, None, None, version)
        hit = log.join(keys.select(*pk), pk, "left_semi").groupBy("branch_id", "seq_from").count().collect()
        touched = {(r.branch_id, r.seq_from) for r in hit}
        old = self._table(table)["files"]
        self._rewrite(table, retention.purge(log, keys, pk), version)
        for i, c in list(self.state["commits"].items()):
            if (c["branch"], c["seq"]) in touched and c["seq"] > 0:
                self.state["commits"][i] = {**c, "integrity": "purged"}
        self.state["purges"].append({"table": table, "reason": reason, "by": principal, "at": self.clock(), "versions": sum(r["count"] for r in hit)})
        self._vacuum(old)
        return sum(r["count"] for r in hit)

    def _refuse_dropped(self, table: str, chain: Chain) -> None:
        for b, q in chain:
            for branch, low, high in self._table(table).get("dropped", []):
                if b == branch and low <= q < high and q not in self.pinned(b):
                    raise NotFound(f"history of {table} from {low} to {high} was dropped")

    @_published("admin")
    def drop_history(self, table: str, branch: str, from_seq: int, to_seq: int) -> int:
        """Drops the branch's versions that begin in [from_seq, to_seq) and that no branch, tag or open session shows.

        So every such state stays as it is, and no old value and no deleted row comes back. Folders of which nothing
        stays go without being read again; what stays of the others is written to one folder. Commits within the
        range that nothing stands on can no longer be read. Returns how many versions went.
        """
        t, b = self._table(table), self._branch(branch)
        version = self._widest(table)
        pk = self._keys(table, version)
        pins = sorted(self.pinned(b["id"]))
        mine = intervals(self.log(table, None, None, version), pk).where(F.col("branch_id") == b["id"])
        seen = F.exists(F.array(*[F.lit(q) for q in pins]), lambda q: (q >= F.col("seq_from")) & (q < F.col("seq_to")))
        inside = F.col("seq_from").between(from_seq, to_seq - 1)
        gone = mine.where(inside & ~seen).select("branch_id", "seq_from", "seq_to", *pk)
        n, last = gone.agg(F.count("*"), F.max("seq_to")).first()
        if not n:
            return 0
        hit = [f for f in t["files"] if f["session"] is None and ((f["branch"] == b["id"] and from_seq <= f["seq"] < to_seq) or f.get("shared"))]
        paths = {f["path"] for f in hit}
        # Entries of a shared folder stand for several branches and sessions: all of them move together.
        hit = [f for f in t["files"] if f["path"] in paths]
        rest = self.log(table, None, None, version, hit).join(gone.drop("seq_to"), ["branch_id", "seq_from", *pk], "left_anti")
        t["files"] = [f for f in t["files"] if f["path"] not in paths]
        if not rest.isEmpty():
            old = sorted({(f["branch"], f["session"]) for f in hit}, key=str)
            self._rewrite(table, rest, version, old, t["files"])
        self._vacuum(hit)
        # A state past the range may have shown what began within it.
        t.setdefault("dropped", []).append([b["id"], from_seq, max(last, to_seq)])
        self._thin(table, b["id"], from_seq, to_seq)
        return n

    def _thin(self, table: str, branch_id: str, low: int, high: int) -> None:
        """Commits with seqs in [low, high) may lack rows: their ids still bind them, their digests cannot be told."""
        for i, c in list(self.state["commits"].items()):
            if c["branch"] == branch_id and low <= c["seq"] < high and c["table"] == table and c["integrity"] == "full":
                self.state["commits"][i] = {**c, "integrity": "thinned"}

    @_needs("read")
    def verify_drift(self, table: str, live: DataFrame) -> dict:
        version = self.schema(table)
        pk = self._keys(table, version)
        return retention.drift(live, self.read(table), pk, [c.name for c in version.columns if c.name not in pk]).first().asDict()

    @_published("write")
    def capture(self, table: str, live: DataFrame, principal: str = "") -> dict:
        """Records drift of a live table in the drift log; guarded tables refuse it instead."""
        found = self.verify_drift(table, live)
        if any(found.values()):
            if self._table(table)["write_mode"] == "guarded":
                raise Refused(f"{table} was written directly: {found}")
            self.state["drift"].append({"table": table, "at": self.clock(), "by": principal, **found})
        return found

    @_published("admin")
    def set_write_mode(self, table: str, mode: str) -> None:
        if mode not in ("open", "guarded", "capture"):
            raise ValueError(mode)
        self._table(table)["write_mode"] = mode

    @_needs("read")
    def drift_events(self, table: str) -> int:
        return sum(e["table"] == table for e in self.state["drift"])

    @_needs("read")
    def verify_integrity(self, deep: bool = False) -> list[str]:
        """Commits whose id does not follow from their content; deep also recomputes digests from rows."""
        bad = []
        for i, c in self.state["commits"].items():
            if c["integrity"] == "purged":
                continue
            again = encoding.commit_id(bytes.fromhex(self.state["repo"]["id"]), [bytes.fromhex(p) for p in c["parents"]], bytes.fromhex(c["change"]), bytes.fromhex(c["schema"]), c["author"], c["at"], c["message"], c["external"]).hex()
            if again != i:
                bad.append(i)
            elif deep and c["integrity"] == "full" and c["table"] in self.state["tables"]:
                chain = [tuple(x) for x in c["chain"]]
                version = self._schema_at(c["table"], chain)
                own = self.log(c["table"], chain[:1], None, version).where((F.col("branch_id") == c["branch"]) & (F.col("seq_from") == c["seq"]))
                physical = own.select(*[x.name for x in META.fields], *[F.col(x.name).alias(f"c_{x.id}") for x in version.columns])
                digest = self._change_digest_plain(c["table"], physical, version)
                if digest.hex() != c["change"]:
                    bad.append(i)
        return bad

    def _change_digest_plain(self, table: str, rows: DataFrame, version: sc.Version) -> bytes:
        t = self._table(table)
        typed = {c.id: (F.col(f"c_{c.id}"), _parse(c.type)) for c in version.columns}
        leaf = encoding.leaf_digest(t["id"], F.col("op"), F.col("changed"), [typed[i] for i in t["pk"]], [(c.id, *typed[c.id]) for c in version.columns])
        return encoding.merkle_root(rows.select(leaf.alias("leaf")))

    @_needs("read")
    def verify_intervals(self, table: str) -> DataFrame:
        version = self._widest(table)
        pk = self._keys(table, version)
        return retention.interval_faults(intervals(self.log(table, None, None, version), pk), pk)

    # Sinks

    @_needs("read")
    def materialize(self, branch: str = "main", prefix: str = "", copy: bool = False) -> list[str]:
        """Every table of a branch as a temporary view, or as saved tables with copy."""
        names = []
        for table in sorted(self.state["tables"]):
            df = self.read(table, branch)
            if copy:
                df.write.mode("overwrite").saveAsTable(f"{prefix}{table}")
            else:
                df.createOrReplaceTempView(f"{prefix}{table}")
            names.append(f"{prefix}{table}")
        return names

    @_needs("read")
    def export(self, table: str, path: str, branch: str = "main") -> None:
        chain = self._chain(branch, None, None)
        version = self._schema_at(table, chain)
        log = self.log(table, chain, None, version)
        columns = self.spark.createDataFrame([(c.id, c.name, c.type, c.nullable) for c in version.columns], "id int, name string, type string, nullable boolean")
        ex.write(ex.records({"repo": self.state["repo"]["name"], "table": table, "branch": branch}, columns, self.commits(branch), log, [c.name for c in version.columns]), path)


def _parse(kind: str) -> T.DataType:
    return T._parse_datatype_string(kind) if kind not in ("varchar", "text") else T.StringType()


def _version(entry: dict, pk: list[int]) -> sc.Version:
    return sc.Version(tuple(sc.Column(**c) for c in entry["columns"]), tuple(pk), tuple(entry["dropped"]), entry["epoch"])


def sc_version(table: dict, branch: str) -> sc.Version:
    return _version(table["schemas"][branch], table["pk"])


def _columns(version: sc.Version) -> dict[int, str]:
    return {c.id: c.name for c in version.columns}
