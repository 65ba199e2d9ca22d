"""Top-level declarations of brace languages by a small scanner, of Python by its own parser.

The scanner blanks comments and strings (so places stay as they are), cuts the text into statements at brace depth 0,
and reads each statement's header by its language's rules. It rather misses a declaration than invents one.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from typing import NamedTuple

WORD = r"[A-Za-z_$][A-Za-z0-9_$]*"
NOT_CALLS = frozenset(
    "if for while switch return catch function func fun fn def class struct new throw sizeof typeof else do in is as when guard let var val const match loop move unsafe await "
    "async yield and or not foreach using lock fixed super this self static public private protected defer go select range synchronized assert".split()
)


@dataclass
class Declaration:
    name: str
    namespace: str | None
    kind: str
    path: str
    line: int
    language: str
    supertypes: list[str] = field(default_factory=list)
    refs: list[str] = field(default_factory=list)
    confidence: str = "high"
    visibility: str = "public"
    tags: list[str] = field(default_factory=list)
    loc: int = 0
    signature: str = ""
    method_count: int = 0


@dataclass
class Import:
    raw: str
    qualified: str | None = None
    alias: str | None = None
    bindings: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Reexport:
    source: str
    names: list[tuple[str, str]] = field(default_factory=list)
    star: bool = False
    alias: str | None = None


@dataclass
class Parsed:
    declarations: list[Declaration] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    reexports: list[Reexport] = field(default_factory=list)
    skipped: list[tuple[int, str]] = field(default_factory=list)


class Statement(NamedTuple):
    start: int
    head: int  # where the header ends
    body: int  # -1: none
    end: int


def blanked(text: str, line: tuple[str, ...] = ("//",), block: tuple[str, str] | None = ("/*", "*/"), quotes: str = "\"'", long: tuple[str, ...] = ()) -> str:
    """The text with comments and the insides of strings as spaces; line feeds and length stay."""
    marks = [re.escape(m) + r"[^\n]*" for m in line]
    if block:
        marks.append(re.escape(block[0]) + r"[\s\S]*?(?:" + re.escape(block[1]) + r"|\Z)")
    marks += [re.escape(q) + r"[\s\S]*?(?:" + re.escape(q) + r"|\Z)" for q in long]
    marks += [rf"{q}(?:\\.|[^{q}\\\n])*{q}?" if q != "`" else r"`(?:\\.|[^`\\])*`?" for q in quotes]

    def blank(m: re.Match) -> str:
        s = m[0]
        keep = s[0] if s[0] in quotes and not any(s.startswith(x) for x in long) else ""
        out = re.sub(r"[^\n]", " ", s)
        return keep + out[1:-1] + keep if keep and len(s) > 1 else out

    return re.sub("|".join(marks), blank, text)


class Source:
    def __init__(self, text: str, path: str, language: str, newline_ends: bool = False, **marks) -> None:
        self.text, self.path, self.language, self.newline_ends = text, path, language, newline_ends
        self.clean = blanked(text, **marks)
        self.out = Parsed()

    def line(self, at: int) -> int:
        return self.text.count("\n", 0, at) + 1

    def closing(self, at: int) -> int:
        """Just behind the brace that closes the one at `at`; the end of the text if none does."""
        depth = 0
        for m in re.finditer("[{}]", self.clean[at:]):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return at + m.end()
        return len(self.clean)

    def statements(self, at: int, end: int) -> Iterator[Statement]:
        s = self.clean
        while at < end:
            while at < end and (s[at].isspace() or s[at] in ";},"):
                at += 1
            if at >= end:
                return
            start, depth = at, 0
            if s[at] == "#" and self.language in ("c", "cpp", "objc"):  # a preprocessor line ends with its line
                while at < end and not (s[at] == "\n" and s[at - 1] != "\\"):
                    at += 1
                yield Statement(start, at, -1, at)
                continue
            while at < end:
                c = s[at]
                if c in "([":
                    depth += 1
                elif c in ")]":
                    depth -= 1
                elif c == "{" and depth <= 0:
                    stop = min(self.closing(at), end)
                    yield Statement(start, at, at, stop)
                    at = stop
                    break
                elif c == ";" and depth <= 0:
                    yield Statement(start, at, -1, at)
                    at += 1
                    break
                elif c == "\n" and depth <= 0 and self.newline_ends:
                    rest = s[at:end].lstrip()
                    annotation = re.fullmatch(r"(?:@[\w.]+(?:\([^)]*\))?\s*)+", s[start:at])
                    if not annotation and not rest.startswith(("{", ":", ".", "->", "=>", "where", "extends", "implements")) and not s[start:at].rstrip().endswith((",", ":", "=", "->")):
                        yield Statement(start, at, -1, at)
                        at += 1
                        break
                at += 1
            else:
                yield Statement(start, end, -1, end)

    def header(self, st: Statement) -> str:
        return " ".join(self.text[st.start : st.head].split())

    def clean_header(self, st: Statement) -> str:
        return " ".join(self.clean[st.start : st.head].split())

    def calls(self, start: int, end: int, more: str = "") -> list[str]:
        """Distinct names before a parenthesis and after new, sorted; `more` adds a pattern whose group 1 is a name."""
        body = self.clean[start:end]
        found = {m[1] for m in re.finditer(rf"({WORD})\s*(?:::<[^()<>]*>|<[\w\s,.<>\[\]?]*>)?\s*\(", body)}
        found |= {m[1].split(".")[-1] for m in re.finditer(rf"\bnew\s+({WORD}(?:\.{WORD})*)", body)}
        if more:
            found |= {m[1] for m in re.finditer(more, body)}
        return sorted(found - NOT_CALLS)

    def add(self, st: Statement, name: str, kind: str, namespace: str | None, **more) -> Declaration:
        end = st.end if st.body >= 0 else st.head
        d = Declaration(name, namespace or None, kind, self.path, self.line(st.start), self.language, loc=self.line(max(st.start, end - 1)) - self.line(st.start) + 1, **{"signature": self.header(st), **more})
        if st.body >= 0 and self.clean[st.end - 1 : st.end] != "}":
            d.confidence = "low"
            self.out.skipped.append((d.line, "unbalanced"))
        self.out.declarations.append(d)
        return d

    def methods(self, st: Statement, pattern: str) -> int:
        if st.body < 0:
            return 0
        return sum(bool(re.search(pattern, self.clean_header(x))) for x in self.statements(st.body + 1, st.end - 1))


def path_namespace(path: str, drop: tuple[str, ...] = (), tails: tuple[str, ...] = (), repeat: bool = False) -> str:
    """Dotted path without its extension; leading folders in `drop` (all, or the first) and a last part in `tails` go."""
    parts = re.sub(r"\.[^./]+$", "", path).split("/")
    while len(parts) > 1 and parts[0] in drop:
        parts = parts[1:]
        if not repeat:
            break
    if parts and parts[-1] in tails:
        parts = parts[:-1]
    return ".".join(parts)


def names_in(text: str) -> list[str]:
    """Names of a comma list, with their qualifiers, without generics and arguments."""
    flat, depth = [], 0
    for c in text:
        depth += (c in "<(") - (c in ">)")
        flat.append(c if depth == 0 and c not in ">)" else "")
    parts = [p.strip().split(" ")[-1] for p in "".join(flat).split(",")]
    return [p for p in parts if p]


def python(text: str, path: str) -> Parsed:
    out = Parsed()
    tree = ast.parse(text)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out.imports += [Import(a.name, a.name, a.asname or a.name.split(".")[-1]) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            raw = "." * node.level + (node.module or "")
            out.imports.append(Import(raw, raw, raw.split(".")[-1], [(a.asname or a.name, a.name) for a in node.names]))
    namespace = path_namespace(path, tails=("__init__",))
    lines = text.split("\n")
    for node in tree.body:
        if not isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        called = {c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))}
        is_class = isinstance(node, ast.ClassDef)
        bases = [ast.unparse(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))] if is_class else []
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        private = node.name.startswith("_") and not re.fullmatch("__.*__", node.name)
        head = "\n".join(lines[node.lineno - 1 : node.body[0].lineno]).rsplit(":", 1)[0] if node.body[0].lineno > node.lineno else lines[node.lineno - 1].rsplit(":", 1)[0]
        methods = sum(isinstance(b, (ast.FunctionDef, ast.AsyncFunctionDef)) for b in node.body) if is_class else 0
        out.declarations.append(Declaration(node.name, namespace or None, "class" if is_class else "function", path, first, "python", bases, sorted(called), "high", "private" if private else "public", [], (node.end_lineno or first) - first + 1, " ".join(head.split()) + ":", methods))
    return out


def typescript(text: str, path: str) -> Parsed:
    s = Source(text, path, "typescript", newline_ends=True, quotes="\"'`")
    namespace = path_namespace(path, ("src", "lib", "app"), ("index",), repeat=True)
    kinds = {"class": "class", "interface": "interface", "function": "function", "enum": "enum", "type": "type_alias"}

    def pairs(listed: str) -> list[tuple[str, str]]:
        out = []
        for part in filter(None, (p.strip() for p in listed.split(","))):
            a, _, b = re.sub(r"^type\s+", "", part).partition(" as ")
            out.append((b.strip() or a.strip(), a.strip()))
        return out

    for m in re.finditer(r"(?m)^\s*(import|export)\b([^;]*?)\bfrom\s*(['\"])([^'\"\n]*)\3", text):
        word, what, source = m[1], m[2].strip(), m[4]
        if not s.clean[m.start(1)].strip():
            continue
        what = re.sub(r"^type\s+", "", what)
        if word == "export":
            star = re.fullmatch(r"\*(?:\s*as\s+(\S+))?", what)
            if star:
                s.out.reexports.append(Reexport(source, [], True, star[1]))
            elif what.startswith("{"):
                s.out.reexports.append(Reexport(source, pairs(what.strip("{} \n"))))
            continue
        bound: list[tuple[str, str]] = []
        inner = re.search(r"\{([^}]*)\}", what)
        for part in filter(None, (p.strip() for p in re.sub(r"\{[^}]*\}", "", what).split(","))):
            bound.append((part.split()[-1], "*") if part.startswith("*") else (part, "default"))
        s.out.imports.append(Import(source, source, source.split("/")[-1], bound + (pairs(inner[1]) if inner else [])))
    for st in s.statements(0, len(text)):
        h = s.clean_header(st)
        m = re.match(rf"(export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(class|interface|function|enum|type)\b\s*\*?\s*({WORD})", h)
        const = re.match(rf"(export\s+)?(const)\s+enum\s+({WORD})", h)
        m = const or m
        if not m:
            continue
        kind = "enum" if const else kinds[m[2]]
        if kind == "type_alias" and "=" not in h and st.body < 0:
            continue
        lists = re.findall(r"\b(?:extends|implements)\s+(.*?)(?=\bimplements\b|\bextends\b|$)", h[m.end() :]) if kind in ("class", "interface") else []
        supers = [re.split(r"\.", n)[-1] for part in lists for n in names_in(part)]
        s.add(st, m[3], kind, namespace, supertypes=supers, refs=s.calls(st.body, st.end) if st.body >= 0 else [], visibility="public" if m[1] else "private", method_count=s.methods(st, rf"^(?:[\w]+\s+)*[\w$#]+\s*(?:<[^>]*>)?\(") if kind == "class" else 0)
    return s.out


def go(text: str, path: str) -> Parsed:
    s = Source(text, path, "go", newline_ends=True, quotes="\"'`")
    package = re.search(r"(?m)^package\s+(\w+)", s.clean)
    folder = ".".join(path.split("/")[:-1])
    namespace = ".".join(x for x in (folder, package[1] if package else "") if x)
    for block in re.finditer(r"(?m)^import\s*(\([\s\S]*?\)|[^\n]*)", text):
        for m in re.finditer(r"(?:([\w.]+)\s+)?\"([^\"\n]+)\"", block[1]):
            s.out.imports.append(Import(m[2], m[2], m[1] or m[2].split("/")[-1]))
    imported = [i.qualified for i in s.out.imports]
    owners: dict[str, int] = {}
    types: list[Declaration] = []
    for st in s.statements(0, len(text)):
        h = s.clean_header(st)
        f = re.match(rf"func\s*(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)[^)]*\)\s*)?({WORD})", h)
        t = re.match(rf"type\s+({WORD})(?:\[[^\]]*\])?\s*(=?)\s*(struct|interface)?", h)
        if f:
            refs = (s.calls(st.body, st.end) if st.body >= 0 else []) + imported
            owner = f[1]
            if owner:
                owners[owner] = owners.get(owner, 0) + 1
            s.add(st, f[2], "method" if owner else "function", f"{namespace}.{owner}" if owner else namespace, refs=refs, visibility="public" if f[2][0].isupper() else "private")
        elif t:
            kind = t[3] or ("type_alias" if t[2] or re.search(r"\bfunc\b|\*|\[|map\b|chan\b", h[t.end() :]) else "type")
            supers, methods = [], 0
            if kind == "interface" and st.body >= 0:
                rows = [r.strip() for r in s.clean[st.body + 1 : st.end - 1].split("\n") if r.strip()]
                methods = sum("(" in r for r in rows)
                supers = [r for r in rows if re.fullmatch(r"[\w.]+", r)]
            types.append(s.add(st, t[1], kind, namespace, supertypes=supers, refs=list(imported), method_count=methods, visibility="public" if t[1][0].isupper() else "private"))
    for d in types:
        if d.kind != "interface":
            d.method_count = owners.get(d.name, 0)
    return s.out


def rust(text: str, path: str) -> Parsed:
    s = Source(text, path, "rust", quotes='"')
    namespace = path_namespace(path, ("src", "lib"), ("mod", "lib", "main"))
    methods: dict[str, int] = {}
    for m in re.finditer(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", s.clean):
        raw = " ".join(m[1].split())
        qualified, _, alias = raw.partition(" as ")
        s.out.imports.append(Import(raw, qualified, alias or qualified.split("::")[-1]))
    imported = [i.qualified for i in s.out.imports]
    for st in s.statements(0, len(text)):
        h = re.sub(r"^(?:#!?\[[^\]]*\]\s*)+", "", s.clean_header(st))
        impl = re.match(rf"impl\b(?:<[^>]*>)?\s*(?:[\w:<>, ']+\s+for\s+)?({WORD})", h)
        if impl:
            methods[impl[1]] = methods.get(impl[1], 0) + s.methods(st, r"\bfn\s+\w+")
            continue
        m = re.match(rf"(pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe|extern)\s+(?:\"[^\"]*\"\s*)?)*(struct|enum|trait|fn|mod)\s+({WORD})", h)
        if not m:
            continue
        kind = {"fn": "function", "mod": "module"}.get(m[2], m[2])
        bounds = re.search(r"^[^:]*\w(?:<[^>]*>)?\s*:\s*([^{]*)$", h) if kind == "trait" else None
        supers = [b.strip().split("<")[0] for b in bounds[1].split("+")] if bounds else []
        refs = (s.calls(st.body, st.end, rf"({WORD})!\s*[(\[{{]") if st.body >= 0 else []) + imported
        s.add(st, m[3], kind, namespace, supertypes=supers, refs=refs, visibility="public" if m[1] else "private", method_count=s.methods(st, r"\bfn\s+\w+") if kind == "trait" else 0)
    for d in s.out.declarations:
        if d.kind in ("struct", "enum"):
            d.method_count = methods.get(d.name, 0)
    return s.out


def java(text: str, path: str) -> Parsed:
    s = Source(text, path, "java", long=('"""',))
    package = re.search(r"(?m)^\s*package\s+([\w.]+)", s.clean)
    for m in re.finditer(r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", s.clean):
        s.out.imports.append(Import(m[1], m[1], m[1].split(".")[-1]))
    for st in s.statements(0, len(text)):
        h = s.clean_header(st)
        m = re.search(rf"(?:^|\s)(class|interface|@interface|record|enum)\s+({WORD})", h)
        if not m or st.body < 0:
            continue
        tail = re.sub(r"^\s*(?:<[^{]*?>)?\s*(?:\([^)]*\))?", "", h[m.end() :])
        supers = [n for part in re.findall(r"\b(?:extends|implements)\s+(.*?)(?=\bimplements\b|\bpermits\b|$)", tail) for n in names_in(part)]
        private = bool(re.search(r"\bprivate\b", h[: m.start()]))
        refs = s.calls(st.body, st.end) + [i.qualified for i in s.out.imports]
        s.add(st, m[2], m[1].lstrip("@"), package[1] if package else None, supertypes=supers, refs=refs, visibility="private" if private else "public", method_count=s.methods(st, rf"^(?!.*=).*{WORD}\s*\([^()]*\)[^=]*$"))
    return s.out


SCREEN_ENDINGS = ("Screen", "Page", "View", "Route", "Dialog", "Sheet", "Content")


def kotlin(text: str, path: str) -> Parsed:
    s = Source(text, path, "kotlin", newline_ends=True, long=('"""',))
    package = re.search(r"(?m)^\s*package\s+([\w.]+)", s.clean)
    for m in re.finditer(r"(?m)^\s*import\s+([\w.*]+)(?:\s+as\s+(\w+))?", s.clean):
        s.out.imports.append(Import(m[1], m[1], m[2] or m[1].split(".")[-1]))
    imported = [i.qualified for i in s.out.imports]
    for st in s.statements(0, len(text)):
        h = s.clean_header(st)
        m = re.match(rf"((?:@[\w.]+(?:\([^)]*\))?\s*|\b(?:public|private|internal|protected|open|abstract|final|inline|value|expect|actual|fun)\s+)*)(data\s+class|sealed\s+class|sealed\s+interface|enum\s+class|annotation\s+class|class|interface|object)\s+({WORD})", h)
        f = re.match(rf"((?:@[\w.]+(?:\([^)]*\))?\s*|\b(?:public|private|internal|inline|suspend)\s+)*)fun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?({WORD})\s*\(", h)
        if m:
            kind = {"sealed interface": "interface", "annotation class": "class"}.get(" ".join(m[2].split()), "_".join(m[2].split()))
            rest = re.sub(r"^\s*(?:<[^>]*>)?\s*(?:(?:private|internal|protected)?\s*constructor\s*)?", "", h[m.end() :])
            if rest.startswith("("):
                depth = 0
                for i, c in enumerate(rest):
                    depth += (c == "(") - (c == ")")
                    if not depth:
                        rest = rest[i + 1 :].strip()
                        break
            supers = [re.split(r"\s+by\s+", n)[0].split(".")[-1] for n in names_in(rest[1:])] if rest.startswith(":") else []
            refs = (s.calls(st.body, st.end) if st.body >= 0 else []) + imported
            s.add(st, m[3], kind, package[1] if package else None, supertypes=supers, refs=refs, visibility="private" if "private" in m[1] else "public", method_count=s.methods(st, r"\bfun\s+"))
        elif f and "@Composable" in f[1] and f[2].endswith(SCREEN_ENDINGS):
            s.add(st, f[2], "composable_function", package[1] if package else None, refs=(s.calls(st.body, st.end) if st.body >= 0 else []) + imported)
    return s.out


def csharp(text: str, path: str) -> Parsed:
    s = Source(text, path, "csharp")
    for m in re.finditer(r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", s.clean):
        s.out.imports.append(Import(m[1], m[1], m[1].split(".")[-1]))
    imported = [i.qualified for i in s.out.imports]

    def read(start: int, end: int, around: str) -> None:
        for st in s.statements(start, end):
            h = s.clean_header(st)
            n = re.match(r"namespace\s+([\w.]+)", h)
            if n:
                inner = f"{around}.{n[1]}" if around else n[1]
                if st.body >= 0:
                    read(st.body + 1, st.end - 1, inner)
                else:
                    around = inner  # the rest of the file
                continue
            m = re.match(rf"((?:\[[^\]]*\]\s*|\b(?:public|private|internal|protected|static|abstract|sealed|partial|readonly|ref|file|unsafe)\s+)*)(class|interface|struct|enum|record(?:\s+(?:class|struct))?)\s+({WORD})", h)
            if not m:
                continue
            base = re.search(r":\s*([^:{]*?)(?:\bwhere\b.*)?$", re.sub(r"\([^)]*\)", "", h[m.end() :]))
            kind = m[2].split()[0]
            private = re.search(r"\bprivate\b", m[1])
            s.add(st, m[3], kind, around, supertypes=names_in(base[1]) if base and kind != "enum" else [], refs=(s.calls(st.body, st.end) if st.body >= 0 else []) + imported, visibility="private" if private else "public", method_count=s.methods(st, rf"^(?!.*\b(?:class|struct|interface|record|delegate)\b)[^=]*{WORD}\s*(?:<[^>]*>)?\([^()]*\)"))
            if st.body >= 0 and kind != "enum":
                read(st.body + 1, st.end - 1, f"{around}.{m[3]}" if around else m[3])

    read(0, len(text), "")
    return s.out


def c_family(text: str, path: str, language: str) -> Parsed:
    """C and C++: definitions at file scope and inside namespaces, extern blocks and #if branches."""
    s = Source(text, path, language)
    drop = ("src",) if language == "c" else ("src", "lib", "include", "source")
    by_path = path_namespace(path, drop)
    for m in re.finditer(r"(?m)^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", text):
        s.out.imports.append(Import(m[1], None, m[1].split("/")[-1]))
    seen: set[tuple] = set()

    def add(st: Statement, name: str, kind: str, around: str, **more) -> None:
        namespace = around or by_path
        key = (kind, namespace, name, "" if language == "c" else s.header(st) if kind == "function" else "")
        if key not in seen:
            seen.add(key)
            s.add(st, name, kind, namespace, **more)

    def read(start: int, end: int, around: str) -> None:
        held: Statement | None = None
        for st in s.statements(start, end):
            h = s.clean_header(st)
            before, held = held, None
            if h.startswith("#"):
                continue
            n = re.match(r"(?:inline\s+)?namespace\s*([\w:]*)$", h)
            if n and st.body >= 0 and language == "cpp":
                name = n[1].replace("::", ".")
                read(st.body + 1, st.end - 1, ".".join(x for x in (around, name) if x))
                continue
            if re.match(r'extern\s+"\s*"$', h) and st.body >= 0:
                read(st.body + 1, st.end - 1, around)
                continue
            h = re.sub(r"^template\s*<[^{}]*?>\s*(?=\b(?:class|struct|union|enum|[\w:]+\s)[^>])", "", h)
            t = re.match(rf"(typedef\s+)?(class|struct|union|enum(?:\s+(?:class|struct))?)\s+(?:[A-Z_]+\s+)?({WORD})?\s*(?:final\s*)?(?::\s*([^{{]*))?$", h)
            if t and st.body >= 0 and (language == "cpp" or t[2] == "struct"):
                if t[3]:
                    kind = t[2].split()[0]
                    bases = [re.sub(r"^(?:(?:public|private|protected|virtual)\s+)+", "", b.strip()) for b in (t[4] or "").split(",")] if kind in ("class", "struct") else []
                    body = Statement(st.start, st.head, st.body, st.end)
                    inside = re.sub(r"\b(?:public|private|protected)\s*:", lambda x: " " * len(x[0]), s.clean[st.body : st.end])
                    methods = len(re.findall(rf"(?<![.>=]){WORD}\s*\([^()]*\)\s*(?:const\s*|noexcept\s*|override\s*|final\s*)*\{{", _first_level(inside))) if kind in ("class", "struct") else 0
                    add(body, t[3], kind, around, supertypes=[b.split("<")[0].strip() for b in bases if b], refs=s.calls(st.body, st.end) if kind != "enum" else [], method_count=methods)
                continue
            d = re.match(rf"typedef\b.*?({WORD})\s*(?:\[[^\]]*\])?$", h)
            if d and language == "c":
                add(st, d[1], "typedef", around)
                continue
            if st.body < 0:
                held = st if re.fullmatch(rf"{WORD}\s*\([^()]*\)", h) else None
                continue
            f = re.match(rf"((?:[\w:<>,*&\[\]]+[\s*&]+)+)((?:{WORD}::)*~?{WORD})\s*\((.*)\)\s*(?:const|noexcept|override|->[^{{]*|\s)*(?::.*)?$", h)
            macro = re.match(rf"((?:static|inline|extern)\s+)?([A-Za-z_]*[A-Z][A-Za-z_0-9]*)\s*\(\s*({WORD})\s*(?:,.*)?\)$", h)
            typed = f and re.sub(r"\b(?:static|inline|extern)\b", "", f[1]).strip()  # a lone storage word is no return type
            if typed and "=" not in f[1] and f[2].split("::")[-1] not in NOT_CALLS and not re.match(r"(?:else|return|typedef)\b", h):
                name = f[2].split("::")[-1]
                add(st, name, "function", around, refs=s.calls(st.body, st.end), visibility="private" if re.search(r"\bstatic\b", f[1]) else "public")
            elif macro:
                add(st, macro[3], "function", around, refs=s.calls(st.body, st.end), confidence="low", tags=["macro-defined"], visibility="private" if "static" in (macro[1] or "") else "public")
            elif re.match(r"[A-Z_0-9]{3,}\b", h):
                s.out.skipped.append((s.line(st.start), "macro_prefixed_misparse"))

    read(0, len(text), "")
    return s.out


def _first_level(body: str) -> str:
    """A body without what stands deeper than its first level, the braces of which stay."""
    out, depth = [], 0
    for c in body:
        if c == "}":
            depth -= 1
        if depth <= 1 or c == "\n":
            out.append(c)
        depth += c == "{"
    return "".join(out)


def swift(text: str, path: str) -> Parsed:
    s = Source(text, path, "swift", newline_ends=True, quotes='"', long=('"""',))
    namespace = path_namespace(path, ("Sources", "src", "Source"))
    for m in re.finditer(r"(?m)^\s*(?:@\w+\s+)?import\s+(?:(?:class|struct|func|enum|protocol)\s+)?([\w.]+)", s.clean):
        s.out.imports.append(Import(m[1], m[1], m[1].split(".")[-1]))
    imported = [i.qualified for i in s.out.imports]
    access = r"((?:@[\w.]+(?:\([^)]*\))?\s*|\b(?:public|private|fileprivate|internal|open|final|static|indirect|mutating|override|prefix|infix)\s+)*)"
    extensions: list[tuple[str, list[str], Statement]] = []
    for st in s.statements(0, len(text)):
        h = s.clean_header(st)
        e = re.match(rf"{access}extension\s+([\w.]+)\s*(?::\s*([^{{]*?))?(?:\bwhere\b.*)?$", h)
        m = re.match(rf"{access}(class|struct|enum|actor|protocol)\s+({WORD})\s*(?:<[^>]*>)?\s*(?::\s*(.*?))?(?:\bwhere\b.*)?$", h)
        f = re.match(rf"{access}func\s+({WORD})", h)
        private = "private" in (e or m or f)[1] if (e or m or f) else False
        if e and st.body >= 0:
            extensions.append((e[2], names_in(e[3] or ""), st))
        elif m and st.body >= 0:
            s.add(st, m[3], m[2], namespace, supertypes=names_in(m[4] or ""), refs=s.calls(st.body, st.end) + imported, visibility="private" if private else "public", method_count=s.methods(st, r"\bfunc\s+"))
        elif f:
            s.add(st, f[2], "function", namespace, refs=(s.calls(st.body, st.end) if st.body >= 0 else []) + imported, visibility="private" if private else "public")
    own = {d.name: d for d in s.out.declarations if d.kind != "function"}
    seen: set[tuple[str, str]] = set()
    for name, supers, st in extensions:
        if name in own:
            d = own[name]
            d.supertypes += [x for x in supers if x not in d.supertypes]
            d.refs = sorted({*d.refs, *s.calls(st.body, st.end)} - set(imported)) + imported
            d.method_count += s.methods(st, r"\bfunc\s+")
            continue
        for member in s.statements(st.body + 1, st.end - 1):
            f = re.match(rf"{access}func\s+({WORD})", s.clean_header(member))
            if f and (name, f[2]) not in seen:
                seen.add((name, f[2]))
                s.add(member, f[2], "function", namespace, refs=(s.calls(member.body, member.end) if member.body >= 0 else []) + imported, tags=["extension-method"])
    return s.out


def objc(text: str, path: str) -> Parsed:
    s = Source(text, path, "objc", quotes='"')
    namespace = path_namespace(path, ("src", "Sources", "Classes"))
    for m in re.finditer(r"(?m)^\s*#\s*(?:import|include)\s*[<\"]([^>\"\n]+)[>\"]", text):
        s.out.imports.append(Import(m[1], m[1], re.sub(r"\.h$", "", m[1].split("/")[-1])))
    blocks = list(re.finditer(rf"(?m)^\s*@(interface|protocol|implementation)\s+({WORD})\s*(\([^)]*\))?\s*(?::\s*({WORD}))?\s*(?:<([^>]*)>)?([\s\S]*?)^\s*@end", s.clean))
    sent = {m[2]: sorted(set(re.findall(rf"\[\s*(?:[^\[\]]|\[[^\[\]]*\])*?\s({WORD})\s*[\]:]", m[6]))) for m in blocks if m[1] == "implementation"}
    declared = {m[2] for m in blocks if m[1] == "interface"}
    seen: set[str] = set()
    for m in blocks:
        if m[3] or m[2] in seen or (m[1] == "implementation" and m[2] in declared):
            continue
        seen.add(m[2])
        at = s.text.index("@", m.start())
        supers = ([m[4]] if m[4] else []) + [p.strip() for p in (m[5] or "").split(",") if p.strip()]
        line = s.line(at)
        s.out.declarations.append(Declaration(m[2], namespace, "protocol" if m[1] == "protocol" else "class", path, line, "objc", supers, sent.get(m[2], []) + [i.raw for i in s.out.imports], loc=s.line(m.end()) - line + 1, method_count=len(re.findall(r"(?m)^\s*[-+]\s*\(", m[6]))))
    return s.out


def lua(text: str, path: str) -> Parsed:
    out = Parsed()
    clean = blanked(text, line=("--",), block=("--[[", "]]"), quotes="\"'")
    for m in re.finditer(r"\brequire\s*\(?\s*(['\"])([^'\"\n]+)\1", text):
        out.imports.append(Import(m[2], m[2], m[2].split(".")[-1]))
    imported = [i.qualified for i in out.imports]
    namespace = path_namespace(path, ("src", "lib", "lua"))
    opening = re.compile(r"\b(function|if|do|repeat|end|until)\b")
    for m in re.finditer(rf"(?m)^(?:local\s+)?function\s+((?:{WORD}[.:])*({WORD}))\s*\([^)]*\)", clean):
        depth, end = 0, len(clean)
        for t in opening.finditer(clean, m.start()):
            depth += -1 if t[1] in ("end", "until") else 1
            if not depth:
                end = t.end()
                break
        calls = {c[1] for c in re.finditer(rf"({WORD})\s*\(", clean[m.end() : end])} - NOT_CALLS - {"require"}
        line = text.count("\n", 0, m.start()) + 1
        out.declarations.append(Declaration(m[2], namespace, "function", path, line, "lua", [], sorted(calls) + imported, loc=text.count("\n", m.start(), end) + 1, signature=" ".join(text[m.start() : m.end()].split())))
    return out


def dart(text: str, path: str) -> Parsed:
    s = Source(text, path, "dart", long=('"""', "'''"))
    namespace = path_namespace(path, ("lib", "src", "bin"))
    for m in re.finditer(r"(?m)^\s*(?:import|export)\s+(['\"])([^'\"\n]+)\1(?:\s+as\s+(\w+))?", text):
        s.out.imports.append(Import(m[2], m[2], m[3] or re.sub(r"\.dart$", "", m[2].split("/")[-1])))
    imported = [i.qualified for i in s.out.imports]
    for st in s.statements(0, len(text)):
        h = re.sub(r"^(?:@[\w.]+(?:\([^)]*\))?\s*)+", "", s.clean_header(st))
        m = re.match(rf"(?:(?:abstract|sealed|base|final|interface)\s+)*(class|mixin|enum|extension)\s+({WORD})", h)
        f = re.match(rf"(?:[\w<>?,\[\] ]+\s+)?({WORD})\s*(?:<[^>]*>)?\(.*\)\s*(?:async\*?|sync\*)?\s*(?:=>.*)?$", h)
        refs = (s.calls(st.body, st.end) if st.body >= 0 else []) + imported
        if m and st.body >= 0:
            supers = [n for part in re.findall(r"\b(?:extends|implements|with|on)\s+(.*?)(?=\b(?:extends|implements|with|on)\b|$)", h[m.end() :]) for n in names_in(part)]
            s.add(st, m[2], m[1], namespace, supertypes=supers, refs=refs, method_count=s.methods(st, rf"{WORD}\s*(?:<[^>]*>)?\([^=]*\)\s*(?:async\*?)?$") if m[1] != "enum" else 0, visibility="private" if m[2].startswith("_") else "public")
        elif f and st.body >= 0 and f[1] not in NOT_CALLS and not h.startswith(("import", "export", "part", "typedef")):
            s.add(st, f[1], "function", namespace, refs=refs, visibility="private" if f[1].startswith("_") else "public")
    return s.out


#: By language; each takes (text, path).
PARSERS: dict[str, Callable[[str, str], Parsed]] = {
    "python": python, "typescript": typescript, "go": go, "rust": rust, "java": java, "kotlin": kotlin, "csharp": csharp, "swift": swift, "objc": objc, "lua": lua, "dart": dart,
    "c": lambda text, path: c_family(text, path, "c"), "cpp": lambda text, path: c_family(text, path, "cpp"),
}


def parse(text: str, path: str, language: str) -> Parsed:
    """What a file declares; an error of any kind becomes a skipped row."""
    parser = PARSERS.get(language)
    if parser is None:
        return Parsed()
    try:
        return parser(text, path)
    except Exception as e:  # noqa: BLE001  one file must not end the job
        return Parsed(skipped=[(0, f"exception: {type(e).__name__}")])


def as_rows(parsed: Parsed) -> dict[str, list[dict]]:
    return {
        "declarations": [asdict(d) for d in parsed.declarations],
        "imports": [{"raw": i.raw, "qualified": i.qualified, "alias": i.alias, "bindings": [{"local": a, "imported": b} for a, b in i.bindings]} for i in parsed.imports],
        "reexports": [{"source": r.source, "star": r.star, "alias": r.alias, "names": [{"local": a, "imported": b} for a, b in r.names]} for r in parsed.reexports],
        "skipped": [{"line": n, "reason": why} for n, why in parsed.skipped],
    }
