"""A working part of XPath 1.0 over the parsed document: paths of child, descendant, attribute, parent and self steps with
predicates, unions, and string(), count() and normalize-space() of a path.
"""

from __future__ import annotations

import re

from siteloom.functions.html import Node, spaced

_STEP = re.compile(r"(//|/|^)\s*(?:(child|descendant|descendant-or-self|attribute|parent|self|ancestor)::)?(@?)([\w-]+(?:\(\))?|\*|\.\.|\.)((?:\[(?:[^\[\]\"']|\"[^\"]*\"|'[^']*')*\])*)")
_PREDICATE = re.compile(r"\[((?:[^\[\]\"']|\"[^\"]*\"|'[^']*')*)\]")
_CALL = re.compile(r"(string|count|normalize-space)\((.*)\)$", re.S)
_TEST = re.compile(r"(not\()?\s*(?:(contains|starts-with)\(\s*([^,]+?)\s*,\s*(\"[^\"]*\"|'[^']*')\s*\)|([^=!<>]+?)\s*(=|!=)\s*(\"[^\"]*\"|'[^']*'|\d+)|(@?[\w-]+(?:\(\))?|\.))\s*(\))?$", re.S)


class Attribute:
    __slots__ = ("owner", "name")

    def __init__(self, owner: Node, name: str):
        self.owner, self.name = owner, name

    def text(self) -> str:
        return spaced(self.owner.get(self.name) or "")


def _text(item) -> str:
    return spaced(item) if isinstance(item, str) else item.text()


def _elements(n: Node) -> list[Node]:
    return [c for c in n.children if isinstance(c, Node)]


def _step(item, deep: bool, axis: str, attribute: bool, name: str) -> list:
    if not isinstance(item, Node):
        return [item.owner] if isinstance(item, Attribute) and (name == ".." or axis == "parent") else [item] if name == "." else []
    if name == "." or axis == "self":
        return ([item, *item.walk()] if deep else [item]) if name in (".", "*", item.tag) else []
    if name == ".." or axis == "parent":
        return [item.parent] if item.parent is not None else []
    if axis == "ancestor":
        out, up = [], item.parent
        while up is not None and up.tag != "#document":
            out += [up] if name in ("*", up.tag) else []
            up = up.parent
        return out
    owners = [item, *item.walk()] if deep or axis.startswith("descendant") else [item]
    if attribute or axis == "attribute":
        return [Attribute(o, a) for o in owners for a in o.attrs if name in ("*", a)]
    if name == "text()":
        return [c for o in owners for c in o.children if isinstance(c, str)]
    return [c for o in owners for c in _elements(o) if name in ("*", c.tag) or name == "node()"]


def _value(item, of: str) -> str | None:
    of = of.strip()
    if of in (".", "text()", "string()", "normalize-space()", "normalize-space(.)"):
        return _text(item)
    found = _path(item, of) if isinstance(item, Node) else []
    return _text(found[0]) if found else None


def _holds(item, place: int, last: int, test: str) -> bool:
    for op, join in ((" or ", any), (" and ", all)):
        if op in test:
            return join(_holds(item, place, last, t) for t in test.split(op))
    test = test.strip()
    if test.isdigit():
        return place == int(test)
    if test == "last()":
        return place == last
    m = _TEST.match(test)
    if not m:
        raise ValueError(f"predicate {test!r}")
    turned, call, of, want, left, op, right, exists, _ = m.groups()
    if call:
        have = _value(item, of) or ""
        got = want[1:-1] in have if call == "contains" else have.startswith(want[1:-1])
    elif op:
        have = str(place) if left.strip() == "position()" else _value(item, left)
        want = right if right.isdigit() else right[1:-1]
        got = have is not None and ((have == want) == (op == "="))
    else:
        got = _value(item, exists) is not None
    return got != bool(turned)


def _path(start: Node, path: str) -> list:
    path = path.strip()
    if not path:
        raise ValueError("empty path")
    here, at = [start], 0
    if path.startswith("/"):
        while here[0].parent is not None:
            here = [here[0].parent]
    while at < len(path):
        m = _STEP.match(path, at)
        if not m or m.end() == at:
            raise ValueError(f"path {path!r}")
        slash, axis, attribute, name, predicates = m.groups()
        out, seen = [], set()
        for item in here:
            # A number in a predicate counts among the steps from one parent.
            groups = [_step(o, False, axis or "", bool(attribute), name) for o in ([item, *item.walk()] if isinstance(item, Node) else [])] if slash == "//" and name != "." else [_step(item, slash == "//", axis or "", bool(attribute), name)]
            for found in groups:
                for p in _PREDICATE.findall(predicates):
                    found = [x for i, x in enumerate(found, 1) if _holds(x, i, len(found), p)]
                for x in found:
                    k = (id(x.owner), x.name) if isinstance(x, Attribute) else id(x)
                    if k not in seen:
                        seen.add(k)
                        out.append(x)
        here, at = out, m.end()
    return here


def evaluate(doc: Node, expression: str) -> list[str]:
    """The values an XPath expression finds, white space collapsed; what is no such expression raises ValueError."""
    m = _CALL.match(expression.strip())
    if m:
        found = _path(doc, m.group(2))
        return [str(len(found))] if m.group(1) == "count" else [_text(found[0])] if found else []
    values: list[str] = []
    for part in re.split(r"\|(?=(?:[^\"']|\"[^\"]*\"|'[^']*')*$)", expression):
        values += map(_text, _path(doc, part))
    return values
