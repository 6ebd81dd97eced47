"""Expressions, projections and unwinding on Python documents, for collections of mixed types."""

from __future__ import annotations

from typing import Any

from docloom.errors import NotSupported, QueryError
from docloom.plans.expressions import check_path
from docloom.values import MISSING


def follow(path: list[str], v: Any) -> Any:
    """A field path in an expression: an array on the way gives the array of its documents' values; numbers don't index."""
    if not path:
        return v
    if isinstance(v, dict):
        return follow(path[1:], v[path[0]]) if path[0] in v else MISSING
    if isinstance(v, list):
        return [x for e in v if isinstance(e, (dict, list)) and (x := follow(path, e) if isinstance(e, dict) else MISSING) is not MISSING]
    return MISSING


def check_expression(e: Any) -> None:
    if isinstance(e, str) and e.startswith("$$"):
        name, _, rest = e[2:].partition(".")
        if name not in ("ROOT", "CURRENT"):
            raise NotSupported(f"the variable $${name}")
        if rest:
            check_path(rest)
    elif isinstance(e, str) and e.startswith("$"):
        check_path(e[1:])
    elif isinstance(e, dict) and not (len(e) == 1 and "$literal" in e):
        for name, x in e.items():
            if name.startswith("$"):
                raise NotSupported(f"the expression {name}")
            if "." in name:
                raise QueryError(16412, "FieldPath field names may not contain '.'.")
            check_expression(x)
    elif isinstance(e, (list, tuple)):
        for x in e:
            check_expression(x)


def evaluate(e: Any, doc: dict) -> Any:
    if isinstance(e, str) and e.startswith("$$"):
        rest = e.partition(".")[2]
        return follow(rest.split(".") if rest else [], doc)
    if isinstance(e, str) and e.startswith("$"):
        return follow(e[1:].split("."), doc)
    if isinstance(e, dict):
        if len(e) == 1 and "$literal" in e:
            return e["$literal"]
        return {k: v for k, x in e.items() if (v := evaluate(x, doc)) is not MISSING}
    if isinstance(e, (list, tuple)):
        return [None if (v := evaluate(x, doc)) is MISSING else v for x in e]
    return e


def project(doc: dict, mode: str, tree: dict, root: dict | None = None) -> dict:
    root = doc if root is None else root
    if mode == "exclude":
        return _exclude(doc, tree)
    if root is doc and tree.get("_id") is not False:
        tree = {"_id": True} | tree
    return _include(doc, {k: v for k, v in tree.items() if v is not False}, root)


def _exclude(v: Any, tree: dict) -> Any:
    if isinstance(v, list):
        return [_exclude(x, tree) for x in v]
    if not isinstance(v, dict):
        return v
    return {k: _exclude(x, tree[k]) if isinstance(tree.get(k), dict) else x for k, x in v.items() if tree.get(k) is not False}


def _include(doc: dict, tree: dict, root: dict) -> dict:
    out = {}
    for k, x in doc.items():
        node = tree.get(k)
        if node is True:
            out[k] = x
        elif isinstance(node, dict) and (kept := _within(x, node, root)) is not MISSING:
            out[k] = kept
    for k, node in tree.items():
        if isinstance(node, tuple):
            out.pop(k, None)
            if (v := evaluate(node[1], root)) is not MISSING:
                out[k] = v
        elif isinstance(node, dict) and k not in doc and (made := _computed(node, root)) is not MISSING:
            out[k] = made
    return out


def _computed(node: dict, root: dict) -> Any:
    """The document of a sub-projection's computed fields, MISSING if it has none."""
    if not any(isinstance(v, (tuple, dict)) for v in node.values()):
        return MISSING
    out, any_computed = {}, False
    for k, v in node.items():
        if isinstance(v, tuple):
            any_computed = True
            if (x := evaluate(v[1], root)) is not MISSING:
                out[k] = x
        elif isinstance(v, dict) and (x := _computed(v, root)) is not MISSING:
            any_computed = True
            out[k] = x
    return out if any_computed else MISSING


def _within(v: Any, node: dict, root: dict) -> Any:
    if isinstance(v, list):
        return [x for e in v if (x := _within(e, node, root)) is not MISSING]
    if isinstance(v, dict):
        return _include(v, node, root)
    return _computed(node, root)


def unwind(doc: dict, path: list[str], keep: bool, index: str | None) -> list[dict]:
    v: Any = doc
    for name in path:
        v = v.get(name, MISSING) if isinstance(v, dict) else MISSING
    if isinstance(v, list) and v:
        return [put(put(doc, path, x), index.split("."), i) if index else put(doc, path, x) for i, x in enumerate(v)]
    if isinstance(v, list) or v is None or v is MISSING:
        if not keep:
            return []
        doc = put(doc, path, MISSING) if isinstance(v, list) else doc
    return [put(doc, index.split("."), None) if index else doc]


def put(doc: dict, path: list[str], value: Any) -> dict:
    """A copy of the document with the value at a path through documents; MISSING removes the field."""
    name, rest = path[0], path[1:]
    out = dict(doc)
    if rest:
        inner = out.get(name)
        out[name] = put(inner if isinstance(inner, dict) else {}, rest, value)
    elif value is MISSING:
        out.pop(name, None)
    else:
        out[name] = value
    return out
