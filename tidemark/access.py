"""Who may do what: capabilities by principal, keys held as digests; and signed checkpoints of branch heads."""

from __future__ import annotations

import hashlib
import hmac
import json
from dataclasses import dataclass, field

# The names of the capabilities.
CAPABILITIES = ("read", "write", "branch", "merge", "approve", "admin", "purge")
_ORDINARY = frozenset(CAPABILITIES) - {"admin", "purge"}


class Denied(PermissionError):
    pass


@dataclass
class Access:
    """Writers may read; administrators may do all but purge, which is granted by itself."""

    grants: dict[str, set[str]] = field(default_factory=dict)
    keys: dict[str, str] = field(default_factory=dict)  # digest of a key -> principal

    @classmethod
    def of(cls, state: dict) -> Access:
        """As a repository's state records it."""
        return cls({p: set(held) for p, held in state.get("grants", {}).items()}, dict(state.get("keys", {})))

    def put(self, state: dict) -> None:
        state["grants"], state["keys"] = {p: sorted(held) for p, held in self.grants.items()}, self.keys

    def grant(self, principal: str, *capabilities: str, key: str | None = None) -> None:
        if unknown := set(capabilities) - set(CAPABILITIES):
            raise ValueError(f"no capability {sorted(unknown)[0]}")
        self.grants.setdefault(principal, set()).update(capabilities)
        if key is not None:
            self.keys[hashlib.sha256(key.encode()).hexdigest()] = principal

    def principal(self, key: str) -> str:
        digest = hashlib.sha256(key.encode()).hexdigest()
        found = [p for held, p in self.keys.items() if hmac.compare_digest(held, digest)]
        if not found:
            raise Denied("unknown key")
        return found[0]

    def may(self, principal: str, capability: str) -> bool:
        held = self.grants.get(principal, set())
        implied = _ORDINARY if "admin" in held else frozenset({"read"}) if "write" in held else frozenset()
        return capability in held or capability in implied

    def require(self, principal: str, capability: str) -> None:
        if not self.may(principal, capability):
            raise Denied(f"{principal} may not {capability}")


def checkpoint(repository, branch: str, secret: bytes) -> dict:
    """The head of a branch under a keyed SHA-256; kept elsewhere, it shows a rewritten history."""
    b = repository.state["branches"][branch]
    body = {"repo": repository.state["repo"]["id"], "branch": branch, "head": b["head"], "seq": b["seq"], "at": repository.clock()}
    return {**body, "signature": _sign(body, secret)}


def verify_checkpoint(repository, point: dict, secret: bytes) -> bool:
    """The signature holds, and the head it names is a commit of the branch still."""
    body = {k: v for k, v in point.items() if k != "signature"}
    if not hmac.compare_digest(_sign(body, secret), point.get("signature", "")):
        return False
    c = repository.state["commits"].get(point["head"])
    return bool(c) and point["repo"] == repository.state["repo"]["id"] and c["seq"] == point["seq"]


def sign_commit(repository, commit: str, secret: bytes) -> str:
    """A commit's id under a keyed SHA-256; the id binds all that the commit holds."""
    return _sign({"repo": repository.state["repo"]["id"], "commit": repository._find(commit)}, secret)


def verify_commit(repository, commit: str, secret: bytes, signature: str) -> bool:
    return hmac.compare_digest(sign_commit(repository, commit, secret), signature)


def _sign(body: dict, secret: bytes) -> str:
    return hmac.new(secret, json.dumps(body, sort_keys=True).encode(), hashlib.sha256).hexdigest()
