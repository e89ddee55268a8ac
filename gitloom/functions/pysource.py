"""What one Python source file defines. Called per file inside a Spark task."""

from __future__ import annotations

import ast
import hashlib
import sys
import warnings

# Part of the stored rows: rows of another parser are parsed again.
PRODUCER = "{}.{}.{}+1".format(*sys.version_info[:3])

# The kinds of definition.
KINDS = {"FunctionDef": "function", "AsyncFunctionDef": "async function", "ClassDef": "class"}

DEFINITIONS = (
    "array<struct<position:int,kind:string,qualname:string,fingerprint:string,lineno:int,"
    "end_lineno:int,decorators:array<string>>>"
)


def _named(node, scope=""):
    """(definition, qualified name), each before those inside it."""
    for child in ast.iter_child_nodes(node):
        if type(child).__name__ in KINDS:
            name = scope + child.name
            yield child, name
            inner = "." if isinstance(child, ast.ClassDef) else ".<locals>."
            yield from _named(child, name + inner)
        else:
            yield from _named(child, scope)


def _fingerprint(node) -> str:
    """Equal for definitions that differ only in name and place."""
    if isinstance(node, ast.ClassDef):
        signature = [*node.bases, *node.keywords]
    else:
        signature = [node.args, node.returns]
    parts = [[type(node).__name__]]
    for group in (node.decorator_list, signature, node.body):
        parts.append([ast.dump(item) for item in group if item is not None])
    return hashlib.sha256(repr(parts).encode("utf-8", "surrogatepass")).hexdigest()


def _decorator(node) -> str:
    target = node.func if isinstance(node, ast.Call) else node
    path = target
    while isinstance(path, ast.Attribute):
        path = path.value
    return ast.unparse(target) if isinstance(path, ast.Name) else ast.dump(node)


def read_definitions(source: bytes) -> dict:
    """Either ``definitions`` or ``parse_error`` with where the parser stopped."""
    found = {"definitions": None, "parse_error": None, "error_lineno": None, "error_offset": None}
    # Deep sources recurse in Python frames only; the parser has its own limit.
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 100_000))
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
        found["definitions"] = [
            {
                "position": position,
                "kind": KINDS[type(node).__name__],
                "qualname": qualname,
                "fingerprint": _fingerprint(node),
                "lineno": node.lineno,
                "end_lineno": node.end_lineno,
                "decorators": [_decorator(item) for item in node.decorator_list],
            }
            for position, (node, qualname) in enumerate(_named(tree))
        ]
    except SyntaxError as error:
        found["parse_error"] = f"{type(error).__name__}: {error.msg}"
        found["error_lineno"], found["error_offset"] = error.lineno, error.offset
    except (RecursionError, ValueError) as error:
        found["parse_error"] = f"{type(error).__name__}: {error}"
    finally:
        sys.setrecursionlimit(limit)
    return found
