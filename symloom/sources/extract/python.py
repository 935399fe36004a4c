"""Python files, by the standard library's parser."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator


def module_name(path: str) -> str:
    return path.rsplit(".", 1)[0].strip("/").replace("/", ".")


def import_path(module: str) -> str:
    """Dots to slashes; leading dots are dropped."""
    return module.lstrip(".").replace(".", "/") + ".py"


#: Characters that are parsed at once, as far as statements allow.
PIECE = 1 << 16
#: What can only begin a statement of a module.
_BEGIN = re.compile(r"(?<!\\\n)^(?:@|(?:def|class|async|import|from)\b)", re.M)


class Malformed(Exception):
    """A module that does not parse."""


def trees(path: str, source: str) -> Iterator[tuple[ast.Module, int]]:
    """The module in pieces of whole statements, each with the number of lines before
    it.  A piece that does not parse is joined with what follows; if it reaches the end,
    the module is malformed: that is raised, after the pieces before."""
    begin, line, size = 0, 0, PIECE
    while True:
        near = _BEGIN.search(source, begin + size)
        end = near.start() if near else len(source)
        piece = source[begin:end]
        try:
            tree = ast.parse(piece)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            if near is None:
                raise Malformed(path) from e
            size *= 2
            continue
        yield tree, line
        if near is None:
            return
        begin, line, size = end, line + piece.count("\n"), PIECE


def parse(path: str, content: str) -> list[dict]:
    """All rows of a file; none of a malformed one."""
    try:
        return list(rows(path, content))
    except Malformed:
        return []


def rows(path: str, content: str) -> Iterator[dict]:
    """The rows of a file, piece by piece; a malformed one ends in ``Malformed``."""
    source = content.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")  # as the parser does
    for tree, line in trees(path, source):
        yield from _rows(path, tree, line)


def _rows(path: str, tree: ast.Module, before: int) -> list[dict]:
    out: list[dict] = []
    base = module_name(path)

    def symbol(node: ast.AST, kind: str, name: str, signature: str | None = None) -> str:
        fqn = f"{base}.{name}"
        documented = isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)
        out.append(
            {
                "rec": "symbol", "lang": "python", "kind": kind, "name": name, "fqn": fqn, "signature": signature, "line": before + node.lineno - 1, "col": node.col_offset, "end_line": before + node.end_lineno - 1, "end_col": node.end_col_offset,
                "visibility": "private" if name.startswith("_") else "public", "doc": ast.get_docstring(node) if documented else None,
            }
        )
        return fqn

    def signature(node) -> str:
        back = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        return f"{node.name}({ast.unparse(node.args)}){back}"

    def imports(module: str) -> None:
        out.append({"rec": "edge", "edge_type": "imports", "file_dst": import_path(module)})

    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports(node.names[0].name)
        elif isinstance(node, ast.ImportFrom):
            imports("." * node.level + (node.module or node.names[0].name))
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            symbol(node, "function", node.name, signature(node))
        elif isinstance(node, ast.ClassDef):
            owner = symbol(node, "class", node.name, f"class {node.name}")
            for b in node.bases:
                out.append({"rec": "edge", "edge_type": "extends", "src": owner, "dst": ast.unparse(b)})
            for x in node.body:
                if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
                    inner = symbol(x, "function" if x.decorator_list else "method", x.name, signature(x))
                    out.append({"rec": "edge", "edge_type": "contains", "src": owner, "dst": inner})
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(t, ast.Name) and not t.id.startswith("__"):
                    symbol(node, "variable", t.id)
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                out.append({"rec": "occurrence", "role": "call", "line": before + node.lineno - 1, "col": node.col_offset, "token": name})
    return out
