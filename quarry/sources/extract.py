"""Source files to definitions and references, one Arrow batch at a time."""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relations import dedup_definitions, enclosing, number_symbols
from .packs import KEYWORDS, compile_pack

TYPES = {"cls", "struct", "iface"}
BODIES = {"fn", "method"}
SCHEMA = (
    "file_id int, is_def boolean, seq bigint, name string, kind string, line int, end_line int, start_byte bigint, end_byte bigint, cx int, "
    "body_start bigint, body_end bigint")
FIELDS = ["file_id", "is_def", "seq", "name", "kind", "line", "end_line", "start_byte", "end_byte", "cx", "body_start", "body_end"]


class Found:
    """Definitions and references of one file; offsets are bytes."""

    def __init__(self, src: bytes):
        self.starts = [0] + [i + 1 for i, b in enumerate(src) if b == 10]
        self.defs: list[tuple] = []
        self.refs: list[tuple] = []

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def add(self, name: str, kind: str, start: int, end: int, cx: int = 0, body: tuple[int, int] | None = None) -> None:
        b = body or (start, end)
        self.defs.append((name, kind, self.line(start), self.line(max(start, end - 1)), start, end, cx, *b))

    def ref(self, name: str, start: int, end: int) -> None:
        self.refs.append((name, start, end))


def _utf8(s: str) -> str:
    return s.encode("latin-1").decode("utf-8", "replace")


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


def _braces(text: str) -> dict[int, int]:
    stack, out = [], {}
    for m in re.finditer(r"[{}]", text):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start() + 1
    return out


def _ends(text: str, opens: str) -> dict[int, int]:
    """Openers of `end` blocks and where the matching end is."""
    stack, out = [], {}
    for m in re.finditer(rf"(?m)(?P<o>{opens})|@?\bend\b", text):
        if m.group("o") is not None:
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.end()
    return out


def _gates(text: str) -> list[tuple[int, int]]:
    """Stretches between #if and its #endif, the outermost ones."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r"(?m)^[ \t]*#[ \t]*(if|endif)", text):
        if m.group(1) == "if":
            start = m.end() if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                out.append((start, m.start()))
    return out


def _outer(braces: dict[int, int]) -> list[tuple[int, int]]:
    """Blocks that lie in no other block, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(braces.items()):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def _within(at: int, stretches: list[tuple[int, int]]) -> bool:
    i = bisect.bisect_right(stretches, (at, 1 << 62)) - 1
    return i >= 0 and stretches[i][0] <= at < stretches[i][1]


def _extent(text: str, m: re.Match, how: str, braces: dict[int, int], ends: tuple[list[int], list[int]]) -> tuple[int, int]:
    """(end of the declaration, start of its body)."""
    stop = m.end()
    newline = text.find("\n", stop)
    newline = len(text) if newline < 0 else newline
    if how == "match":
        return stop, stop
    if how == "line":
        semi = text.find(";", stop)
        # A bracketed value may go on over lines.
        brace = text.find("{", stop, newline)
        if brace >= 0 and brace in braces and (semi < 0 or brace < semi):
            return braces[brace], brace
        return (semi + 1 if 0 <= semi < newline else newline), stop
    if how == "end":
        line = text.rfind("\n", 0, m.start("name")) + 1
        openers, closers = ends
        i = bisect.bisect_left(openers, line)
        return (closers[i] if i < len(openers) and openers[i] <= newline else newline), stop
    brace, semi = text.find("{", m.end("name")), text.find(";", m.end("name"))
    if brace >= 0 and brace in braces and (semi < 0 or brace < semi):
        between = text[m.end("name"):brace]
        # Without a block of its own a declaration ends with its statement or line.
        if "\n\n" not in between and "}" not in between:
            return braces[brace], brace
    arrow = text.find("=>", m.start(), newline)
    if arrow >= 0:
        return (semi + 1 if semi >= 0 else newline), arrow + 2
    return (semi + 1 if 0 <= semi and "\n\n" not in text[stop:semi] else newline), stop


def brace_language(lang: str, src: bytes) -> Found:
    pack, blank, rules, refs, decisions = compile_pack(lang)
    plain, reserved = src.decode("latin-1"), KEYWORDS[lang]
    text = blank.sub(_blank, plain)
    found = Found(src)
    braces = _braces(text)
    closed = sorted(_ends(text, pack.opens).items()) if pack.opens else []
    ends = [a for a, _ in closed], [b for _, b in closed]
    gates = _gates(text) if any(r.gated for r, _ in rules) else []
    outer = _outer(braces) if gates else []
    got, names = [], set()
    for rule, pattern in rules:
        for m in pattern.finditer(plain if rule.raw else text):
            first = m.start() + len(m.group()) - len(m.group().lstrip())
            if (rule.raw and text[first:first + 1] != plain[first:first + 1]) or (rule.gated and (not _within(first, gates) or _within(first, outer))):
                continue
            # A statement is no declaration, however it looks after its first word.
            if m.group("name") in reserved or re.match(r"\s*(?:return|throw|new|await|yield|else|goto|delete)\b", m.group()):
                continue
            end, body = _extent(text, m, rule.end, braces, ends)
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            got.append((start, -end, rule, m, body))
    got.sort(key=lambda x: x[:2])
    open_types: list[int] = []
    seen = set()
    for start, neg, rule, m, body in got:
        end = -neg
        while open_types and open_types[-1] <= start:
            open_types.pop()
        inside = bool(open_types)
        kind = (rule.member if inside and rule.member is not None else rule.kind) if inside or rule.free else ""
        if not kind:
            continue
        if kind in TYPES or (lang == "rust" and re.match(r"(?:unsafe\s+)?impl\b", m.group())):
            open_types.append(end)
        if (start, m.start("name"), kind) in seen:
            continue
        seen.add((start, m.start("name"), kind))
        names.add(m.start("name"))
        cx = 1 + sum(1 for _ in decisions.finditer(text, start, end)) if kind in BODIES else 0
        found.add(_utf8(m.group("name")), kind, start, end, cx, (body, end))
    taken = set()
    for pattern in refs:
        for m in pattern.finditer(text):
            at = m.start("name")
            if at in names or at in taken or m.group("name") in reserved:
                continue
            taken.add(at)
            found.ref(_utf8(m.group("name")), at, m.end("name"))
    found.refs.sort(key=lambda r: r[1])
    return found


PY_DECISIONS = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.IfExp)
PY_REPAIRS = 64
PY_LINE = re.compile(rb"(?m)^[ \t]*(?:async[ \t]+def|def|class)[ \t]+(?P<name>[A-Za-z_]\w*)")


def repaired(src: bytes) -> ast.Module | None:
    """The tree of a source whose lines at syntax errors are put aside, one by one, byte for byte; None where that does
    not end. A line that opens a block is kept as one that always runs, so what it holds is still read."""
    rows = src.replace(b"\0", b" ").split(b"\n")
    touched: set[int] = set()
    for _ in range(PY_REPAIRS):
        try:
            return ast.parse(b"\n".join(rows))
        except SyntaxError as e:
            i = min(max((e.lineno or 1) - 1, 0), len(rows) - 1)
            # The reported line may be repaired already; then the fault is in the nearest line before it.
            while i > 0 and (i in touched and not rows[i].strip()):
                i -= 1
            row = rows[i]
            indent, body = row[:len(row) - len(row.lstrip())], row.strip()
            stand_in = b"if 1:" if body.endswith(b":") else b"pass"
            again = i in touched or len(body) < len(stand_in)
            touched.add(i)
            rows[i] = (b" " * len(row)) if again else (indent + stand_in).ljust(len(row))
        except (ValueError, RecursionError, MemoryError):
            return None
    return None


def python_file(src: bytes) -> Found:
    found = Found(src)
    try:
        tree = ast.parse(src)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        tree = repaired(src)
    if tree is None:
        # What is left is what lines say by themselves.
        for m in PY_LINE.finditer(src):
            at = m.start() + len(m.group()) - len(m.group().lstrip())
            found.add(m.group("name").decode(), "cls" if src[at:at + 5] == b"class" else "fn", at, m.end(), int(src[at:at + 5] != b"class"))
        return found
    pos = lambda line, col: found.starts[line - 1] + col

    def span(node) -> tuple[int, int]:
        return pos(node.lineno, node.col_offset), pos(node.end_lineno, node.end_col_offset)

    def complexity(node) -> int:
        n = 1
        for x in ast.walk(node):
            if isinstance(x, PY_DECISIONS):
                # elif is not a statement of its own.
                word = src[pos(x.lineno, x.col_offset):pos(x.lineno, x.col_offset) + 4] if isinstance(x, ast.If) else b""
                n += word != b"elif"
        return n

    def targets(node) -> Iterator[ast.expr]:
        for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
            yield from t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t]

    def visit(node, where: str) -> None:
        for child in ast.iter_child_nodes(node):
            inner = where
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                body = child.body[0]
                found.add(child.name, "fn", *span(child), complexity(child), (pos(body.lineno, body.col_offset), span(child)[1]))
                inner = "fn"
            elif isinstance(child, ast.ClassDef):
                body = child.body[0]
                found.add(child.name, "cls", *span(child), 0, (pos(body.lineno, body.col_offset), span(child)[1]))
                inner = "cls"
            elif isinstance(child, (ast.Assign, ast.AnnAssign)):
                for t in targets(child):
                    if isinstance(t, ast.Attribute):
                        found.add(t.attr, "var", *span(child))
                    elif isinstance(t, ast.Name) and where in ("module", "guard", "cls"):
                        fn = where == "cls" and isinstance(child.value, ast.Lambda)
                        found.add(t.id, "fn" if fn else "var", *span(child), complexity(child) if fn else 0)
            elif where == "module" and isinstance(child, (ast.If, ast.Try)):
                inner = "guard"
            elif where == "guard" and isinstance(child, (ast.If, ast.Try)):
                inner = "deep"
            if isinstance(child, ast.Call):
                f = child.func
                if isinstance(f, ast.Name):
                    found.ref(f.id, pos(f.lineno, f.col_offset), pos(f.end_lineno, f.end_col_offset))
                elif isinstance(f, ast.Attribute):
                    end = pos(f.end_lineno, f.end_col_offset)
                    found.ref(f.attr, end - len(f.attr.encode()), end)
            visit(child, inner)

    visit(tree, "module")
    found.refs.sort(key=lambda r: r[1])
    return found


JSON_TOKEN = re.compile(rb'"(?:\\.|[^"\\])*"|[{}\[\],:]|[^\s{}\[\],:"]+')


def json_file(src: bytes) -> Found:
    """Keys of the root object and of the objects that are its values."""
    found, stack = Found(src), []
    waiting: list[tuple] = []  # keys whose values are not ended
    tokens = [(m.group(), m.start(), m.end()) for m in JSON_TOKEN.finditer(src)]
    for i, (tok, start, end) in enumerate(tokens):
        if tok in (b"{", b"["):
            stack.append(tok)
        elif tok in (b"}", b"]"):
            if stack:
                stack.pop()
        elif tok[:1] == b'"' and i + 1 < len(tokens) and tokens[i + 1][0] == b":" and stack and all(s == b"{" for s in stack) and len(stack) <= 2:
            waiting.append((tok[1:-1].decode("utf-8", "replace"), len(stack), start))
            continue
        if waiting and tok not in (b"{", b"[", b":", b",") and len(stack) == waiting[-1][1]:
            name, _, at = waiting.pop()
            found.add(name, "sec", at, end)
        elif waiting and tok == b"}" and len(stack) < waiting[-1][1]:
            waiting.pop()
    return found


TOML_LINE = re.compile(rb'[ \t]*(?:\[\[?\s*(?P<table>[^\]\n]+?)\s*\]\]?|(?P<key>(?:"[^"\n]*"|\'[^\'\n]*\'|[\w-]+)(?:\s*\.\s*(?:"[^"\n]*"|\'[^\'\n]*\'|[\w-]+))*)\s*=)')


def toml_file(src: bytes) -> Found:
    """Tables and keys; values over several lines are not looked into."""
    found, at, depth, text = Found(src), 0, 0, None
    for raw in src.split(b"\n"):
        end = at + len(raw)
        if text is not None:
            text = None if text in raw else text
        elif depth == 0 and (m := TOML_LINE.match(raw)):
            group = "table" if m.group("table") else "key"
            if group == "key" or b"=" not in raw[:m.end()]:
                found.add(m.group(group).decode("utf-8", "replace"), "sec", at + m.start(group), end)
            value = raw[m.end():] if group == "key" else b""
            for q in (b'"""', b"'''"):
                if value.count(q) == 1:
                    text = q
            bare = re.sub(rb'"(?:\\.|[^"\\])*"|\'[^\']*\'|#.*', b"", value)
            depth += bare.count(b"[") + bare.count(b"{") - bare.count(b"]") - bare.count(b"}")
        elif depth:
            bare = re.sub(rb'"(?:\\.|[^"\\])*"|\'[^\']*\'|#.*', b"", raw)
            depth = max(0, depth + bare.count(b"[") + bare.count(b"{") - bare.count(b"]") - bare.count(b"}"))
        at = end + 1
    return found


YAML_KEY = re.compile(rb'^(?P<i>[ ]*)(?:- +)*(?P<key>"[^"\n]*"|\'[^\'\n]*\'|[^\s#\-\[\]{},&*!|>%@`"\'][^:#\n]*?|-[^\s:][^:#\n]*?)[ ]*:(?=\s|$)')
YAML_FLOW = re.compile(rb'[{,]\s*(?P<key>"[^"\n]*"|[\w.-]+)\s*:(?=[\s"\[{]|\w)')


def yaml_file(src: bytes) -> Found:
    """Block keys of every depth, and keys of flow mappings."""
    found, at, scalar = Found(src), 0, None
    rows = src.split(b"\n")
    keys = []
    for raw in rows:
        indent = len(raw) - len(raw.lstrip(b" "))
        if scalar is not None and (not raw.strip() or indent > scalar):
            at += len(raw) + 1
            continue
        scalar = None
        m = YAML_KEY.match(raw)
        if m:
            keys.append((m.group("key").decode("utf-8", "replace"), len(m.group("i")), at + m.start("key"), at + len(raw)))
            if re.search(rb":\s+[|>][-+\d]*\s*$", raw):
                scalar = len(m.group("i"))
        for f in YAML_FLOW.finditer(raw):
            keys.append((f.group("key").decode("utf-8", "replace"), -1, at + f.start("key"), at + f.end()))
        at += len(raw) + 1
    # From the end on: the next block key that is not deeper ends a key's value.
    after: list[tuple[int, int]] = []
    stops = [0] * len(keys)
    for i in range(len(keys) - 1, -1, -1):
        _, indent, start, _ = keys[i]
        if indent >= 0:
            while after and after[-1][0] > indent:
                after.pop()
            stops[i] = after[-1][1] if after else len(src)
            after.append((indent, start))
    for (name, indent, start, end), stop in zip(keys, stops, strict=True):
        if indent >= 0:
            while stop > end and src[stop - 1:stop].isspace():
                stop -= 1
            end = max(end, stop)
        found.add(name.strip("\"'"), "sec", start, end)
    return found


HTML_ATTR = rb"<[A-Za-z][^<>]*?\s(?P<name>%s)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)"


def html_file(src: bytes, attr: str = "id") -> Found:
    found = Found(src)
    pattern = re.compile(HTML_ATTR % re.escape(attr.encode()), re.I)
    for m in pattern.finditer(re.sub(rb"<!--.*?-->", lambda c: re.sub(rb"[^\n]", b" ", c.group()), src, flags=re.S)):
        found.add(m.group("name").decode(), "sec", m.start("name"), m.end())
    return found


SCANNERS = {"python": python_file, "json": json_file, "toml": toml_file, "yaml": yaml_file, "html": html_file}


def extract_file(lang: str, src: bytes) -> Found:
    return SCANNERS[lang](src) if lang in SCANNERS else brace_language(lang, src)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("file_id", pa.int32()), ("is_def", pa.bool_()), ("seq", pa.int64()), ("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()),
        ("end_line", pa.int32()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("cx", pa.int32()), ("body_start", pa.int64()),
        ("body_end", pa.int64())])
    for b in batches:
        rows = []
        for file_id, lang, content in zip(*(b.column(c).to_pylist() for c in ("file_id", "lang", "content")), strict=True):
            found = extract_file(lang, content)
            for i, (name, kind, line, end_line, *rest) in enumerate(found.defs):
                rows.append((file_id, True, i, name, kind, line, end_line, *rest))
            for i, (name, start, end) in enumerate(found.refs):
                rows.append((file_id, False, i, name, None, None, None, start, end, None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


#: Languages whose variables count as constants only if they are named like one.
CONSTANT_LANGS = ("c", "cuda", "cpp", "csharp", "javascript", "typescript", "tsx", "ruby")


def documented_gates(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols without those that stricter rules leave out: variables not named like constants in CONSTANT_LANGS, and
    YAML keys below the second level."""
    s = symbols.join(files.select("file_id", "lang"), "file_id")
    constant = F.col("name").rlike("^[A-Z0-9_]*[A-Z][A-Z0-9_]*$")
    s = s.where(~((F.col("kind") == "var") & F.col("lang").isin(*CONSTANT_LANGS)) | constant)
    keys = s.where("lang = 'yaml'").select("file_id", "sym_id", "start_byte", "end_byte")
    outer = keys.select("file_id", F.col("sym_id").alias("o"), F.col("start_byte").alias("os"), F.col("end_byte").alias("oe"))
    # Keys nest: a key lies deep if the key around it has one around itself. Places just before a key find what is around it.
    around = lambda k: enclosing(k.select("sym_id", "file_id", (F.col("start_byte") - 1).alias("p"), "end_byte"), outer, "sym_id", "file_id",
                                 ("p", "end_byte"), ("os", "oe"), "o").where("enclosing is not null")
    held = around(keys)
    nested = held.select(F.col("sym_id").alias("enclosing"))
    deep = held.join(nested, "enclosing", "left_semi").select("sym_id")
    return s.join(deep, "sym_id", "left_anti").select(symbols.columns)


def extract(files: DataFrame, gates: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(symbols, refs) of files(file_id, lang, content); gates="documented" applies documented_gates."""
    from ..functions.storage import keep

    raw = keep(files.select("file_id", "lang", "content").mapInArrow(_run, SCHEMA), "extract")
    defs = raw.where("is_def").drop("is_def")
    symbols = number_symbols(dedup_definitions(defs)).select(
        "sym_id", "name", "kind", "file_id", "line", "end_line", "start_byte", "end_byte", "cx", "body_start", "body_end")
    if gates == "documented":
        symbols = documented_gates(symbols, files)
    # Unique over files without a sort: a file has far fewer than 2^32 references.
    ref_id = F.shiftleft(F.col("file_id").cast("bigint"), 32) + F.col("seq")
    refs = raw.where("not is_def").select(ref_id.alias("ref_id"), "name", "file_id", "start_byte", "end_byte")
    return symbols, refs
