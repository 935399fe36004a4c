"""TypeScript, JavaScript, Go, Rust, Java, C, C++ and C# by a small scanner.

Comments and strings are blanked (keeping positions), braces give scopes, and a
declaration is what its language's patterns find at the head of a scope or
statement.  Nesting is by position, so broken files still give their parts.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

_BLANK = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*'", re.S)
_RUST_LIFETIME = re.compile(r"'(?=[a-z_]\w*\b(?!'))")
_KEYWORDS = frozenset("if for while switch catch return sizeof new else do try throw typeof function await delete case in of match loop fn func class struct enum super this defer go select range using static_assert decltype alignof import const var".split())

# kind, pattern (name is group "n"); line-anchored, on blanked text.
_M = r"^[ \t]*"
_TS = r"(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?"
_JAVA = r"(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp|synchronized|native|default|@\w+(?:\([^)]*\))?)[ \t]+)*"
_TYPE = r"[\w$.:<>\[\],?&* \t]+?"
RULES = {
    "typescript": [
        ("function", _M + _TS + r"(?:async[ \t]+)?function\*?[ \t]+(?P<n>[\w$]+)[^{;\n]*"),
        ("class", _M + _TS + r"(?:abstract[ \t]+)?class[ \t]+(?P<n>[\w$]+)[^{]*"),
        ("interface", _M + _TS + r"interface[ \t]+(?P<n>[\w$]+)[^{]*"),
        ("enum", _M + _TS + r"(?:const[ \t]+)?enum[ \t]+(?P<n>[\w$]+)"),
        ("type", _M + _TS + r"type[ \t]+(?P<n>[\w$]+)[^=\n]*="),
        ("namespace", _M + _TS + r"(?:namespace|module)[ \t]+(?P<n>[\w$.]+)"),
        ("function", _M + _TS + r"(?:const|let|var)[ \t]+(?P<n>[\w$]+)[^=\n]*=[ \t]*(?:async[ \t]*)?(?:\([^)]*\)|[\w$]+)[^=\n]*=>"),
        ("variable", _M + _TS + r"(?:const|let|var)[ \t]+(?P<n>[\w$]+)"),
        ("method", _M + r"(?:(?:public|private|protected|static|async|readonly|override|get|set|abstract)[ \t]+)*\*?(?P<n>[\w$#]+)[ \t]*(?:<[^>\n]*>)?\([^)]*\)[^;{\n]*(?=\{)"),
    ],
    "go": [
        ("function", _M + r"func[ \t]+(?P<n>\w+)[ \t]*(?:\[[^\]]*\])?\([^{\n]*"),
        ("method", _M + r"func[ \t]*\([ \t]*(?:\w+[ \t]+)?\*?(?P<o>\w+)[^)]*\)[ \t]*(?P<n>\w+)[^{\n]*"),
        ("class", _M + r"type[ \t]+(?P<n>\w+)(?:\[[^\]]*\])?[ \t]+struct"),
        ("interface", _M + r"type[ \t]+(?P<n>\w+)(?:\[[^\]]*\])?[ \t]+interface"),
        ("type", _M + r"type[ \t]+(?P<n>\w+)[ \t]+=?[ \t]*[\w\[\]*.]+"),
        ("constant", _M + r"const[ \t]+(?P<n>\w+)"),
        ("variable", _M + r"var[ \t]+(?P<n>\w+)"),
        ("field", _M + r"(?P<n>[A-Za-z_]\w*)[ \t]+[*\[\]\w.]+[ \t]*(?:`[^`]*`)?[ \t]*$"),
    ],
    "rust": [
        ("function", _M + r"(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:async|const|unsafe|extern)[ \t]+)*fn[ \t]+(?P<n>\w+)[^{;]*"),
        ("struct", _M + r"(?:pub(?:\([^)]*\))?[ \t]+)?struct[ \t]+(?P<n>\w+)"),
        ("enum", _M + r"(?:pub(?:\([^)]*\))?[ \t]+)?enum[ \t]+(?P<n>\w+)"),
        ("trait", _M + r"(?:pub(?:\([^)]*\))?[ \t]+)?(?:unsafe[ \t]+)?trait[ \t]+(?P<n>\w+)"),
        ("module", _M + r"(?:pub(?:\([^)]*\))?[ \t]+)?mod[ \t]+(?P<n>\w+)"),
        ("constant", _M + r"(?:pub(?:\([^)]*\))?[ \t]+)?(?:const|static)[ \t]+(?:mut[ \t]+)?(?P<n>[A-Z_]\w*)[ \t]*:"),
        ("type", _M + r"(?:pub(?:\([^)]*\))?[ \t]+)?type[ \t]+(?P<n>\w+)"),
        ("field", _M + r"(?:pub(?:\([^)]*\))?[ \t]+)?(?P<n>[a-z_]\w*)[ \t]*:[ \t]*[^,;=(){}\n]+,?[ \t]*$"),
    ],
    "java": [
        ("class", _M + _JAVA + r"class[ \t]+(?P<n>\w+)[^{]*"),
        ("interface", _M + _JAVA + r"interface[ \t]+(?P<n>\w+)[^{]*"),
        ("interface", _M + _JAVA + r"@interface[ \t]+(?P<n>\w+)"),
        ("enum", _M + _JAVA + r"enum[ \t]+(?P<n>\w+)[^{]*"),
        ("class", _M + _JAVA + r"record[ \t]+(?P<n>\w+)[ \t]*\([^)]*\)[^{]*"),
        ("method", _M + _JAVA + r"(?:<[^>]*>[ \t]+)?(?:" + _TYPE + r"[ \t]+)?(?P<n>\w+)[ \t]*\([^)]*\)[^;{}=]*(?=[{;])"),
        ("field", _M + _JAVA + _TYPE + r"[ \t]+(?P<n>\w+)[ \t]*(?:=[^;]*)?;"),
    ],
    "cpp": [
        ("class", _M + r"(?:template[ \t]*<[^{;]*>\s*)?class[ \t]+(?P<n>\w+)(?=[^;(]*\{)[^{;]*"),
        ("struct", _M + r"(?:template[ \t]*<[^{;]*>\s*)?(?:typedef[ \t]+)?struct[ \t]+(?P<n>\w+)(?=[^;(]*\{)[^{;]*"),
        ("union", _M + r"(?:typedef[ \t]+)?union[ \t]+(?P<n>\w+)(?=[^;(]*\{)"),
        ("enum", _M + r"(?:typedef[ \t]+)?enum[ \t]+(?:class[ \t]+|struct[ \t]+)?(?P<n>\w+)"),
        ("namespace", _M + r"(?:inline[ \t]+)?namespace[ \t]+(?P<n>[\w:]+)(?=\s*\{)"),
        ("type_alias", _M + r"using[ \t]+(?P<n>\w+)[ \t]*="),
        ("typedef", _M + r"typedef[^;{}]*?\b(?P<n>\w+)[ \t]*;"),
        ("constant", _M + r"#[ \t]*define[ \t]+(?P<n>\w+)"),
        ("function", _M + r"(?:template[ \t]*<[^{;]*>\s*)?(?:" + _TYPE + r"[ \t*&]+)?(?P<n>~?[\w:]+|operator[^\s(]+)[ \t]*\([^;{}]*\)[^;{}=]*(?=\{)"),
        ("method", _M + r"(?:" + _TYPE + r"[ \t*&]+)?(?P<n>~?\w+)[ \t]*\([^;{}]*\)[^;{}]*;"),
        ("field", _M + _TYPE + r"[ \t*&]+(?P<n>\w+)[ \t]*(?:\[[^\]]*\])?[ \t]*(?:=[^;]*)?;"),
    ],
}
RULES["javascript"], RULES["c"] = RULES["typescript"], RULES["cpp"]
_COMPILED = {lang: [(k, re.compile(p, re.M)) for k, p in rules] for lang, rules in RULES.items()}
_OWNERS = frozenset(("class", "interface", "struct", "enum", "trait", "union", "namespace", "module"))
_BODIED = _OWNERS | {"function", "method"}
_CALL = re.compile(r"\b([A-Za-z_$][\w$]*)[ \t]*\(")
_IMPL = re.compile(r"^[ \t]*(?:unsafe[ \t]+)?impl(?:<[^>]*>)?[ \t]+(?:(?P<t>[\w:<>, ]+?)[ \t]+for[ \t]+)?(?P<n>\w+)", re.M)


def blank(text: str, lang: str) -> str:
    """Comments and strings as spaces; line breaks stay."""
    if lang == "rust":
        text = _RUST_LIFETIME.sub(" ", text)
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def scopes(text: str) -> list[tuple[int, int, int]]:
    """``(open, close, depth)`` of every pair of braces; open ones end the file."""
    out, stack = [], []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out.append((stack.pop(), m.start(), len(stack)))
    return sorted([*out, *((at, len(text), i) for i, at in enumerate(stack))])


def _doc(source: str, at: int) -> str | None:
    m = re.search(r"(?:/\*\*?((?:(?!\*/).)*)\*/|((?:^[ \t]*//[^\n]*\n)+))[ \t]*\n?[ \t]*\Z", source[max(0, at - 4000) : at], re.S | re.M)
    if not m:
        return None
    lines = [re.sub(r"^\s*(?:\*|///?!?)\s?", "", x).strip() for x in (m[1] or m[2]).splitlines()]
    return "\n".join(x for x in lines if x) or None


def _visibility(head: str, lang: str, name: str, owner_kind: str | None) -> str | None:
    word = re.search(r"\b(public|private|protected|pub)\b", head)
    if word:
        return "public" if word[1] == "pub" else word[1]
    if lang == "go":
        return "public" if name[:1].isupper() else "private"
    if lang in ("typescript", "javascript"):
        return "public" if "export" in head or owner_kind else "private"
    return {"java": "package", "rust": "private"}.get(lang, "private" if owner_kind == "class" else "public")


def _stem(path: str) -> str:
    return path.rsplit(".", 1)[0]


def _fqn(path: str, lang: str, chain: list[str], name: str, package: str) -> str:
    if lang in ("typescript", "javascript"):
        return f"{_stem(path)}/{name}"
    if lang == "go":
        parts = path.strip("/").split("/")
        return f"{parts[-2] if len(parts) > 1 else 'main'}.{name}"
    if lang == "java":
        return ".".join([*([package] if package else []), *chain, name])
    return "::".join([*chain, name])


def ts_import(path: str, target: str) -> str:
    """A relative target below the file's folder, with an extension; others as they are."""
    if not target.startswith("."):
        return target
    folder = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
    return folder + target + ("" if re.search(r"\.(?:ts|tsx|js|jsx|json)$", target) else ".ts")


def _imports(path: str, source: str, lang: str) -> list[str]:
    if lang in ("typescript", "javascript"):
        return [ts_import(path, m[1]) for m in re.finditer(r"^[ \t]*(?:import|export)\b[^;'\"]*?(?:from[ \t]*)?['\"]([^'\"\n]+)['\"]", source, re.M)]
    if lang == "go":
        out = [m[1] for m in re.finditer(r"^[ \t]*import[ \t]+(?:[\w.]+[ \t]+)?\"([^\"\n]+)\"", source, re.M)]
        for m in re.finditer(r"^[ \t]*import[ \t]*\(([^)]*)\)", source, re.M):
            out += re.findall(r"\"([^\"\n]+)\"", m[1])
        return out
    pattern = {"rust": r"^[ \t]*(?:pub[ \t]+)?use[ \t]+([^;]+);", "java": r"^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.*]+)[ \t]*;"}.get(lang, r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]")
    return [re.sub(r"\s+", " ", m[1]).strip() for m in re.finditer(pattern, source, re.M)]


def _enclosing(intervals: Iterable[tuple], positions: Iterable[int]) -> Iterator[tuple[int, list[tuple]]]:
    """Each position, ascending, with the intervals ``(open, close, ...)`` around
    it, outermost first; intervals nest, so one pass with a stack serves all."""
    todo, stack, i = sorted(intervals, key=lambda x: x[0]), [], 0
    for at in sorted(positions):
        while i < len(todo) and todo[i][0] < at:
            while stack and stack[-1][1] <= todo[i][0]:
                stack.pop()
            stack.append(todo[i])
            i += 1
        while stack and stack[-1][1] <= at:
            stack.pop()
        yield at, stack


_MEMBER = re.compile(r"\s*(?:(?:#\[[^\]]*\]|@\w+(?:\([^)]*\))?)\s*)*([A-Za-z_]\w*)")
_GO_GROUP = re.compile(r"^[ \t]*(const|var)[ \t]*\(", re.M)
_GO_NAMES = re.compile(r"^[ \t]*([A-Za-z_]\w*(?:[ \t]*,[ \t]*[A-Za-z_]\w*)*)", re.M)
_GO_LIST = re.compile(r"^[ \t]*(const|var)[ \t]+([A-Za-z_]\w*(?:[ \t]*,[ \t]*[A-Za-z_]\w*)+)", re.M)
_GO_FIELDS = re.compile(r"^[ \t]*([A-Za-z_]\w*(?:[ \t]*,[ \t]*[A-Za-z_]\w*)+)[ \t]+[*\[\]\w.]", re.M)
_LAMBDA = {
    "java": re.compile(r"(?:\([^()]*\)|\b[A-Za-z_]\w*)[ \t]*->"),
    "cpp": re.compile(r"(?<![\w\])])\[[^\]\n;]*\]\s*(?:\([^()]*\))?[^;{}()\[\]]*(?=\{)"),
}
_STATIC_INIT = re.compile(r"^[ \t]*(static)[ \t]*\{", re.M)
_WORD = re.compile(r"[A-Za-z_]\w*")


def _parts(text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Pieces between commas outside of brackets; a semicolon ends them."""
    depth, at = 0, begin
    for i in range(begin, end):
        c = text[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif depth == 0 and c in ",;":
            yield at, i
            at = i + 1
            if c == ";":
                return
    yield at, end


def _members(text: str, lang: str, found: dict, body: dict) -> Iterator[tuple[int, str, str, int | None]]:
    """``(place, kind, name, declaration)`` of what has no line of its own: enum
    members, names in groups and lists, constructors of records, lambdas and
    initialisers."""
    if lang in ("rust", "java", "c", "cpp"):
        for o in body:
            if found[o][0] == "enum":
                for a, b in _parts(text, body[o][0] + 1, body[o][1]):
                    if m := _MEMBER.match(text, a, b):
                        yield m.start(1), "enum" if lang == "rust" else "enum_member", m[1], o
    if lang == "go":
        for m in _GO_GROUP.finditer(text):
            depth, i = 1, m.end()
            while i < len(text) and depth:
                depth += {"(": 1, ")": -1}.get(text[i], 0)
                if depth == 1 and (text[i - 1] == "\n" or i == m.end()) and (names := _GO_NAMES.match(text, i)):
                    for w in _WORD.finditer(text, names.start(1), names.end(1)):
                        yield w.start(), "constant" if m[1] == "const" else "variable", w[0], None
                i += 1
        for m in _GO_LIST.finditer(text):
            for w in _WORD.finditer(text, m.start(2), m.end(2)):
                yield w.start(), "constant" if m[1] == "const" else "variable", w[0], None
        for o in body:
            if found[o][0] == "class":
                for m in _GO_FIELDS.finditer(text, body[o][0] + 1, body[o][1]):
                    for w in _WORD.finditer(text, m.start(1), m.end(1)):
                        yield w.start(), "field", w[0], o
    if lang in ("java", "c", "cpp"):
        for kind, m in list(found.values()):
            if kind == "field" and "," in m[0]:
                plain = re.sub(r"<[^<>]*>", lambda x: " " * len(x[0]), text[m.start() : m.start("n")])
                for a, b in list(_parts(plain, 0, len(plain)))[:-1]:
                    words = list(_WORD.finditer(plain, a, b))
                    if words:
                        yield m.start() + words[-1].start(), "field", words[-1][0], None
    if lang == "java":
        for o, (kind, m) in list(found.items()):
            if kind == "class" and re.search(r"\brecord[ \t]+$", m[0][: m.start("n") - m.start()]):
                yield o + 1, "constructor", m["n"], o
        for m in _STATIC_INIT.finditer(text):
            yield m.start(1), "initialiser", "<clinit>", None
    for m in _LAMBDA["cpp" if lang == "c" else lang].finditer(text) if lang in ("java", "c", "cpp") else ():
        yield m.start(), "lambda", "", None


def parse(path: str, source: str, lang: str) -> list[dict]:
    return list(rows(path, source, lang))


def rows(path: str, source: str, lang: str) -> Iterator[dict]:
    """The rows of a file, one after the other."""
    if lang == "csharp":
        yield {"rec": "symbol", "lang": lang, "kind": "module", "name": path.rsplit("/", 1)[-1], "fqn": path, "line": 0, "col": 0, "end_line": source.count("\n"), "end_col": 0}
        return
    text = blank(source, lang)
    pairs = scopes(text)
    line_at = [0, *(m.end() for m in re.finditer("\n", text))]

    def place(at: int) -> tuple[int, int]:
        line = bisect_right(line_at, at) - 1
        return line, at - line_at[line]

    package = (re.search(r"^[ \t]*package[ \t]+([\w.]+)", text, re.M) or [None, ""])[1] if lang == "java" else ""
    found: dict[int, tuple[str, re.Match]] = {}
    for kind, pattern in _COMPILED[lang]:
        for m in pattern.finditer(text):
            at = m.start("n")
            if at not in found and m["n"] not in _KEYWORDS and not re.match(r"\s*(?:return|else|throw|new|delete|goto|case)\b", m[0]):
                found[at] = (kind, m)
    opens = [p[0] for p in pairs]
    body = {}  # declaration -> its braces
    for at, (kind, m) in found.items():
        first = bisect_left(opens, m.end("n"))
        near = pairs[first] if first < len(pairs) else None
        gap = text[m.end() : near[0]] if near else ";"
        if near and kind in _BODIED and m.end() <= near[0] and not re.search(r"[;}]|\n[ \t]*\S", gap):
            body[at] = near
    impls = [(m["n"], (m["t"] or "").strip() or None, next((p for p in pairs if p[0] >= m.end()), None)) for m in _IMPL.finditer(text)] if lang == "rust" else []

    own: dict[int, tuple[str, str, int | None]] = {}
    for at, kind, name, o in list(_members(text, lang, found, body)):
        own.setdefault(at, (kind, name, o))
    for at in own:  # what the patterns took for a method or a field
        found.pop(at, None)
        body.pop(at, None)
    spans = [(*body[o][:2], found[o][0], found[o][1]["n"], o) for o in body]
    spans += [(*p[:2], "impl", n, -1) for n, _, p in impls if p]
    around = {at: [(x[2], x[3], x[4]) for x in near] for at, near in _enclosing(spans, [*found, *own])}
    braced = {at for at, near in _enclosing(((p[0], p[1]) for p in pairs), found) if near}

    names: dict[int, str] = {}
    for at in sorted(found):
        kind, m = found[at]
        chain = around[at]
        inner = chain[-1] if chain else None
        if any(k in ("function", "method") for k, _, _ in chain) or (at in braced and not inner and kind in ("field", "method", "function") and lang not in ("go",)):
            continue  # inside a body, or in braces that are no declaration
        if kind == "method" and lang not in ("go",) and (not inner or inner[0] not in (*_OWNERS, "impl")):
            continue
        if kind in ("function",) and inner and inner[0] in (*(_OWNERS - {"namespace", "module"}), "impl"):
            kind = "method"
        if kind == "field" and (not inner or inner[0] not in ("class", "struct", "union", "interface", "enum")):
            if lang in ("c", "cpp") and (not inner or inner[0] == "namespace"):
                kind = "variable"
            else:
                continue
        if kind == "variable" and inner and lang in ("typescript", "javascript"):
            continue
        name = m["n"]
        links = [n for k, n, _ in chain if k != "function"]
        fqn = _fqn(path, lang, links, name, package)
        head = m[0]
        end = body[at][1] if at in body else m.end()
        (line, col), (end_line, end_col) = place(m.start() + len(head) - len(head.lstrip())), place(end)
        names[at] = fqn
        yield (
            {
                "rec": "symbol", "lang": lang, "kind": kind, "name": name, "fqn": fqn, "signature": re.sub(r"\s+", " ", source[m.start() : m.end()]).strip() if kind in ("function", "method", "class", "interface", "struct") else None,
                "line": line, "col": col, "end_line": end_line, "end_col": end_col, "visibility": _visibility(head, lang, name, inner[0] if inner else None), "doc": _doc(source, m.start()),
            }
        )
        if inner and inner[2] in names:
            yield {"rec": "edge", "edge_type": "contains", "src": names[inner[2]], "dst": fqn}
        elif lang == "go" and "o" in m.re.groupindex:
            yield {"rec": "edge", "edge_type": "contains", "src": _fqn(path, lang, [], m["o"], ""), "dst": fqn}
        if kind in ("class", "interface", "struct"):
            for word, edge in ((r"\bextends\b([^{]*?)(?=\bimplements\b|\bpermits\b|$)", "extends"), (r"\bimplements\b([^{]*?)(?=\bpermits\b|$)", "implements"), (r"(?<!:):(?!:)([^{]*)$", "extends" if lang == "cpp" and kind == "class" else "")):
                hit = re.search(word, head) if edge else None
                for t in re.split(r",(?![^<]*>)", hit[1]) if hit else []:
                    t = re.sub(r"\b(?:public|private|protected|virtual)\b", "", t).strip()
                    if t:
                        yield {"rec": "edge", "edge_type": edge, "src": fqn, "dst": t}
    for at in sorted(own):
        kind, name, o = own[at]
        chain = around[at]
        line, col = place(at)
        deep = any(k in ("function", "method") for k, _, _ in chain)
        if deep and kind != "lambda" or o is not None and o not in names:
            continue
        links = [n for k, n, _ in chain if k != "function"]
        if kind == "lambda":
            name, kind = (f"lambda_{line}" if lang == "java" else f"lambda_{line}_{col}"), "function"
            links = [n for k, n, _ in chain if k not in ("function", "method")]
            fqn = _fqn(path, lang, links, name, package)
        elif kind == "initialiser":
            kind, fqn = "method", _fqn(path, lang, links, f"static_init_{line}", package)
        elif kind == "constructor":
            kind, fqn = "method", f"{names[o]}.{name}"
        elif o is not None and lang != "go":
            fqn = f"{names[o]}{'::' if lang == 'rust' else '.'}{name}"
        else:
            fqn = _fqn(path, lang, links, name, package)
        yield {"rec": "symbol", "lang": lang, "kind": kind, "name": name, "fqn": fqn, "line": line, "col": col, "end_line": line, "end_col": col + len(name), "visibility": _visibility("", lang, name, None) if lang == "go" else None}
        holder = o if o is not None else next((x[2] for x in reversed(chain) if x[2] in names), None)
        if holder is not None:
            yield {"rec": "edge", "edge_type": "contains", "src": names[holder], "dst": fqn}
    for name, trait, _ in impls:
        if trait:
            yield {"rec": "edge", "edge_type": "implements", "src": name, "dst": trait}
    yield from ({"rec": "edge", "edge_type": "imports", "file_dst": t} for t in _imports(path, source, lang))
    # without a type before it, a name in a body that the patterns met is called there
    declared = {at for at, (_, m) in found.items() if at in names or m[0][: at - m.start()].strip()} | set(own)
    functions = [(*body[at][:2], names[at]) for at in names if at in body and found[at][0] in ("function", "method")]
    called = {m.start(): m for m in _CALL.finditer(text) if m[1] not in _KEYWORDS and m.start(1) not in declared}
    for at, inside in _enclosing(functions, called):
        m = called[at]
        line, col = place(m.start())
        yield {"rec": "occurrence", "role": "call", "line": line, "col": col, "token": m[1]}
        if lang in ("c", "cpp"):
            if inside:
                yield {"rec": "edge", "edge_type": "calls", "src": inside[-1][2], "dst": m[1]}
        elif lang in ("rust", "java"):
            yield {"rec": "edge", "edge_type": "calls", "src": f"{path}#root", "dst": m[1]}
