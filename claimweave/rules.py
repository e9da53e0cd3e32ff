"""Query atoms and rules as plain Python values."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from claimweave.functions.ids import literal_id


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Ref:
    """An object id used as a constant (as opposed to a literal)."""

    id: str


@dataclass(frozen=True)
class Atom:
    """``rel(arg, ...)``; an argument is a :class:`Var`, a :class:`Ref` or a literal."""

    rel: str
    args: tuple

    def variables(self) -> list[str]:
        return list(dict.fromkeys(a.name for a in self.args if isinstance(a, Var)))


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]
    rule_id: str = ""

    def __post_init__(self):
        if not self.body:
            raise ValueError("a rule needs a body")
        bound = {name for a in self.body for name in a.variables()}
        free = [name for name in self.head.variables() if name not in bound]
        if free:
            raise ValueError(f"head variables not bound by the body: {', '.join(free)}")

    def source(self) -> str:
        return f"{_text(self.head)} :- {', '.join(_text(a) for a in self.body)}"


def _text(a: Atom) -> str:
    def one(x):
        if isinstance(x, Var):
            return f"?{x.name}"
        return x.id if isinstance(x, Ref) else repr(x)

    return f"{a.rel}({', '.join(one(x) for x in a.args)})"


def var(name: str) -> Var:
    return Var(name)


def ref(object_id: str) -> Ref:
    return Ref(object_id)


def atom(rel: str, *args) -> Atom:
    """Strings starting with ``?`` are variables: ``atom("triple", "?x", ref("p"), "?y")``."""
    made = tuple(
        Var(a[1:]) if isinstance(a, str) and len(a) > 1 and a.startswith("?") else a for a in args
    )
    return Atom(rel, made)


def rule(head: Atom, *body: Atom, rule_id: str = "") -> Rule:
    made = Rule(head, tuple(body), rule_id)
    if rule_id:
        return made
    digest = hashlib.sha256(made.source().encode()).hexdigest()[:12]
    return replace(made, rule_id=f"rule:{head.rel}/{digest}")


def constant_id(value: object) -> str:
    """What a base relation stores for a constant: an id, literals being interned."""
    return value.id if isinstance(value, Ref) else literal_id(value)


def constant_raw(value: object) -> object:
    """What a derived relation stores for a constant: the id or the literal itself."""
    return value.id if isinstance(value, Ref) else value
