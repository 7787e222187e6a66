import pytest

from tidemark.access import Access, Denied, checkpoint, verify_checkpoint


def test_capabilities():
    a = Access()
    a.grant("w", "write", key="k1")
    a.grant("root", "admin")
    a.grant("p", "purge")
    assert a.may("w", "read") and not a.may("w", "branch") and not a.may("nobody", "read")
    assert a.may("root", "approve") and not a.may("root", "purge") and a.may("p", "purge") and not a.may("p", "read")
    assert a.principal("k1") == "w"
    with pytest.raises(Denied):
        a.principal("k2")
    with pytest.raises(Denied):
        a.require("w", "merge")
    with pytest.raises(ValueError):
        a.grant("w", "fly")


class Fake:
    def __init__(self):
        self.state = {"repo": {"id": "r"}, "branches": {"main": {"head": "c1", "seq": 3}}, "commits": {"c1": {"seq": 3}}}
        self.clock = lambda: 5


def test_checkpoints():
    r = Fake()
    point = checkpoint(r, "main", b"secret")
    assert verify_checkpoint(r, point, b"secret") and not verify_checkpoint(r, point, b"other")
    assert not verify_checkpoint(r, {**point, "head": "c2"}, b"secret")
    r.state["commits"] = {"c2": {"seq": 3}}
    assert not verify_checkpoint(r, point, b"secret")
