"""Schema changes against the values that types hold, and plans."""

import itertools

import pytest

from tidemark.operators import ddl
from tidemark.operators import schema as sc
from tidemark.operators.schema import Class, Column, Version

KEY, SIZE = Column(1, "k", "bigint", False), Column(2, "size", "int")
BASE = Version((KEY, SIZE), (1,))
BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def beside(*columns):
    return Version((KEY, *columns), (1,))


def largest(kind):
    name, args = sc.parse_type(kind)
    return (1 << (BITS[name] - 1)) - 1 if name in BITS else 10 ** (args[0] - args[1]) - 1


@pytest.mark.parametrize(("a", "b"), list(itertools.permutations([*BITS, "decimal(3,0)", "decimal(5,0)", "decimal(19,0)", "decimal(38,0)"], 2)))
def test_whole_numbers_widen_where_the_largest_fits(a, b):
    level = sc.classify_type(a, b)[0]
    if "decimal" in a and b in BITS:
        assert level == Class.DESTRUCTIVE
    else:
        assert (level == Class.WIDENING) == (largest(b) >= largest(a))


def test_decimals_widen_where_digits_fit_on_both_sides():
    for p, s, q, r in itertools.product(range(1, 6), range(3), range(1, 6), range(3)):
        if s <= p and r <= q:
            level = sc.classify_type(f"decimal({p},{s})", f"numeric({q},{r})")[0]
            assert level == (Class.WIDENING if q - r >= p - s and r >= s else Class.NARROWING)


def test_texts_floats_and_others():
    for n, m in itertools.product((1, 5, 9), repeat=2):
        assert (sc.classify_type(f"varchar({n})", f"varchar({m})")[0] == Class.WIDENING) == (m >= n)
    assert sc.classify_type("varchar(5)", "string")[0] == Class.WIDENING and sc.classify_type("varchar", "varchar(3)")[0] == Class.NARROWING
    for a, b, fits in (("float", "double", True), ("double", "float", False), ("smallint", "float", True), ("int", "float", False), ("int", "double", True), ("bigint", "double", False), ("date", "string", False)):
        assert (sc.classify_type(a, b)[0] == Class.WIDENING) == fits, (a, b)


def test_spellings_name_one_type():
    for group in (("int", "integer", "int4"), ("bigint", "long", "int8"), ("string", "text"), ("double", "float8", "double precision"), ("float", "real"), ("boolean", "bool"), ("decimal(7,2)", "numeric(7, 2)")):
        assert len({sc.parse_type(x) for x in group}) == 1, group


def test_every_kind_of_change():
    cases = {
        "add_column": (beside(SIZE, Column(3, "x", "date")), Class.ADDITIVE), "drop_column": (beside(), Class.DESTRUCTIVE), "rename_column": (beside(Column(2, "length", "int")), Class.DESTRUCTIVE),
        "set_not_null": (beside(Column(2, "size", "int", False)), Class.NARROWING), "drop_not_null": (Version((Column(1, "k", "bigint", True), SIZE), (1,)), Class.WIDENING), "alter_type": (beside(Column(2, "size", "bigint")), Class.WIDENING),
    }
    for kind, (after, level) in cases.items():
        (change,) = sc.diff(BASE, after)
        assert (change.kind, change.level) == (kind, level)
        back = sc.diff(after, BASE)
        assert len(back) == 1


def test_three_way_agrees_with_a_table_of_cases():
    """Every pair of ways to change one column: what either side alone does holds, the same twice holds, else a conflict."""
    ways = {"keep": SIZE, "drop": None, "wide": Column(2, "size", "bigint"), "name": Column(2, "length", "int"), "need": Column(2, "size", "int", False)}
    for (a, ours), (t, theirs) in itertools.product(ways.items(), repeat=2):
        out = sc.merge(BASE, beside(*filter(None, [ours])), beside(*filter(None, [theirs])))
        if a == t or "keep" in (a, t):
            want = ours if t == "keep" else theirs
            assert not out.conflicts and out.result.column(2) == want and (2 in out.result.dropped) == (want is None)
        else:
            assert [c[0] for c in out.conflicts] == [2]


def test_plans_run_safe_steps_first_and_say_what_to_confirm():
    after = Version((KEY, Column(2, "size", "bigint"), Column(4, "x", "date"), Column(5, "y", "int", False)))
    steps = sc.plan(sc.diff(Version((*BASE.columns, Column(3, "old", "string"))), after))
    kinds = [s.kind for s in steps]
    assert [s.level for s in steps] == sorted(s.level for s in steps) and [s.ordinal for s in steps] == list(range(len(steps)))
    assert kinds.index("deprecate_column") < kinds.index("drop_column") and kinds.index("preflight_not_null") < kinds.index("set_not_null")
    assert len(sc.confirmation(steps)) == sum(s.level >= Class.NARROWING for s in steps)
    assert not sc.confirmation(sc.plan(sc.diff(BASE, beside(SIZE, Column(3, "x", "date")))))


def test_projection_and_forks():
    assert BASE.project({1: "a", 2: 3, 3: "later"}) == {1: "a", 2: 3}
    forked = sc.settle(BASE, [Column(0, "k", "bigint", False), Column(0, "size", "string")])
    assert forked.named("size").id == 3 and forked.dropped == (2,)
    again = sc.settle(forked, [Column(0, "k", "bigint", False), Column(0, "size", "string"), Column(0, "x", "int")])
    assert again.named("x").id == 4 and again.named("size").id == 3


def test_every_step_has_a_statement_in_every_dialect():
    after = Version((KEY, Column(2, "length", "bigint", False), Column(4, 'x"`y', "date")))
    steps = sc.plan(sc.diff(Version((*BASE.columns, Column(3, "old", "string"))), after)) + sc.plan(sc.diff(beside(Column(2, "size", "int", False)), BASE))
    for dialect in ddl.DIALECTS:
        made = [x for s in steps for x in ddl.statements("shop.t", s, dialect)]
        assert len(made) == len(steps) and all(ddl.quoted("shop.t", dialect) in x for x in made)
        assert ddl.quoted('x"`y', dialect) in " ".join(made)
    with pytest.raises(ValueError):
        ddl.statements("t", steps[0], "other")
