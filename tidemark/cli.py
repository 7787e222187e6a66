"""A small command line: python -m tidemark.cli REPOSITORY COMMAND ..."""

from __future__ import annotations

import argparse
import re
from decimal import Decimal

from pyspark.sql import SparkSession

from tidemark.functions.expressions import Const
from tidemark.functions.predicates import And, Col, Predicate
from tidemark.functions.values import BOOL, FLOAT, INT, NUMERIC, kind_of
from tidemark.repository import Repository

_TEST = re.compile(r"(\w+)\s*(<=|>=|!=|=|<|>)\s*(.*)", re.S)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--key-file")
    p.add_argument("--wrapping-key-file")
    p.add_argument("path")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        for o, d in options.items():
            if isinstance(d, bool):
                s.add_argument(f"--{o}", action="store_true")
            else:
                s.add_argument(f"--{o}", default=d, type=str if d is None else type(d))
        return s

    add("init", "name", author="cli")
    add("track", "table", "source", pk="", mode="versioned")
    add("tables")
    add("refs")
    add("log", branch="main", limit=20)
    add("show", "table", branch="main", at=None, limit=20)
    add("diff", "table", branch="main", start=0, end=-1)
    add("history", "table", branch="main", limit=20)
    add("blame", "table", branch="main", limit=20)
    add("branch", "name", source="main")
    add("delete-branch", "name")
    add("tag", "name", "at")
    add("merge", "table", "source", "target", author="cli", dry=False, chunked=False)
    add("revert", "table", "commit", branch="main", author="cli", force=False)
    add("prune", "table", days=None, commits=None)
    add("verify", deep=False)
    add("export", "table", "out", branch="main")
    add("sql", "statement", branch="main")
    add("update", "table", "set", where=None, branch="main", author="cli")
    add("delete", "table", "where", branch="main", author="cli")
    add("session-open", "branch", "principal")
    add("session-write", "session", "table", "source")
    add("session-commit", "session", "table", author="cli")
    add("session-abandon", "session")
    add("propose", "source", "target", "title", author="cli")
    add("review", "proposal", "kind", "principal")
    add("proposals")
    add("merge-proposal", "proposal", "table", "principal", chunked=False)
    add("purge", "table", "key", "reason", author="cli")
    add("erase", "table", "subject", author="cli", reason="")
    return p


def _typed(repo: Repository, table: str, branch: str, name: str, text: str):
    kinds = {f.name: f.dataType for f in repo.read(table, branch).schema.fields}
    if name not in kinds:
        raise SystemExit(f"{table} has no column {name}")
    kind = kind_of(kinds[name])
    return int(text) if kind == INT else float(text) if kind == FLOAT else Decimal(text) if kind == NUMERIC else text.lower() == "true" if kind == BOOL else text


def where(repo: Repository, table: str, branch: str, text: str | None) -> Predicate | None:
    """Comparisons such as size >= 3, joined by " and "; text stands as it is."""
    if not text:
        return None
    parts = []
    for piece in text.split(" and "):
        if not (m := _TEST.fullmatch(piece.strip())):
            raise SystemExit(f"not a comparison: {piece}")
        c, value = Col(m[1]), _typed(repo, table, branch, m[1], m[3])
        parts.append({"=": c == value, "!=": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[m[2]])
    return And(parts)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    if a.command == "init":
        Repository.create(spark, a.path, a.name, a.author)
        return 0
    # A principal's own key and the wrapping key (hex) come from files, so that no command line shows them.
    held = lambda path, kind: None if path is None else kind(open(path).read().strip())  # noqa: E731, SIM115
    r = Repository.open(spark, a.path, key=held(a.key_file, str), wrapping_key=held(a.wrapping_key_file, bytes.fromhex))
    if a.command == "track":
        r.track(a.table, spark.read.parquet(a.source), a.pk.split(","), a.mode)
    elif a.command in ("tables", "refs"):
        getattr(r, a.command)().show(1000, False)
    elif a.command == "log":
        r.history_log(a.branch, a.limit).show(a.limit, False)
    elif a.command == "show":
        r.read(a.table, a.branch, at=a.at, limit=a.limit).show(a.limit, False)
    elif a.command == "diff":
        r.diff(a.table, a.branch, a.start, a.end).show(1000, False)
    elif a.command in ("history", "blame"):
        getattr(r, a.command)(a.table, a.branch).show(a.limit, False)
    elif a.command == "branch":
        r.branch(a.name, a.source)
    elif a.command == "delete-branch":
        r.delete_branch(a.name)
    elif a.command == "tag":
        r.tag(a.name, a.at)
    elif a.command == "merge":
        out = r.merge(a.table, a.source, a.target, a.author, apply=not a.dry, chunked=a.chunked)
        out.conflicts.show(1000, False) if not out.clean else out.changes.groupBy("op").count().show()
        return 0 if out.clean else 1
    elif a.command == "revert":
        r.revert(a.table, a.commit, a.branch, a.author, force=a.force)
    elif a.command == "prune":
        print(r.prune(a.table, int(a.days) if a.days else None, int(a.commits) if a.commits else None))
    elif a.command == "verify":
        bad = r.verify_integrity(a.deep)
        print("\n".join(bad) or "intact")
        return 1 if bad else 0
    elif a.command == "export":
        r.export(a.table, a.out, a.branch)
    elif a.command == "sql":
        r.materialize(a.branch)
        spark.sql(a.statement).show(1000, False)
    elif a.command == "update":
        name, value = a.set.split("=", 1)
        print(r.update_where(a.table, where(r, a.table, a.branch, a.where), {name.strip(): Const(_typed(r, a.table, a.branch, name.strip(), value.strip()))}, a.branch, a.author).changed)
    elif a.command == "delete":
        print(r.delete_where(a.table, where(r, a.table, a.branch, a.where), a.branch, a.author).changed)
    elif a.command == "session-open":
        print(r.open_session(a.branch, a.principal))
    elif a.command == "session-write":
        r.session_write(a.session, a.table, spark.read.parquet(a.source))
    elif a.command == "session-commit":
        print(r.commit_session(a.session, a.table, a.author).commit)
    elif a.command == "session-abandon":
        r.abandon_session(a.session)
    elif a.command == "propose":
        print(r.propose(a.source, a.target, a.title, a.author))
    elif a.command == "review":
        r.review(int(a.proposal), a.kind, a.principal)
    elif a.command == "proposals":
        r.proposals().show(1000, False)
    elif a.command == "merge-proposal":
        out = r.merge_proposal(int(a.proposal), a.table, a.principal, a.chunked)
        out.conflicts.show(1000, False) if not out.clean else print(out.commit)
        return 0 if out.clean else 1
    elif a.command == "purge":
        pairs = [x.split("=", 1) for x in a.key.split(",")]
        keys = r.read(a.table).select(*[n.strip() for n, _ in pairs]).limit(0).unionByName(spark.createDataFrame([tuple(_typed(r, a.table, "main", n.strip(), v.strip()) for n, v in pairs)], [n.strip() for n, _ in pairs]))
        print(r.purge(a.table, keys, a.reason, a.author))
    elif a.command == "erase":
        print(r.erase_subject(a.table, a.subject, a.author, a.reason).changed)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
