"""What a source file imports, defines, calls and refers to, one row a blob.

Python goes through the standard parser, the rest through patterns over text with
comments and strings blanked. Nothing raises: an unreadable or huge blob yields
an empty result. Blobs are read once each, whatever the number of their files.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MAX_BYTES, MAX_NAMES, MAX_IMPORTS, MAX_LINKS, MAX_USES, SHORTEST = 1 << 20, 400, 200, 200, 100, 3

_S = T.StringType()
IMPORT = T.StructType([T.StructField("spec", _S), T.StructField("reexport", T.BooleanType()), T.StructField("names", T.ArrayType(_S))])
DEF = T.StructType([T.StructField("name", _S), T.StructField("kind", _S)])
PARSED = T.StructType([
    T.StructField("blob_oid", _S), T.StructField("lang", _S), T.StructField("imports", T.ArrayType(IMPORT)),
        T.StructField("calls", T.ArrayType(_S)), T.StructField("type_refs", T.ArrayType(_S)),
    T.StructField("defs", T.ArrayType(DEF)), T.StructField("doc_links", T.ArrayType(_S)), T.StructField("doc_tokens", T.ArrayType(_S)),
])


class Found:
    """Gathers names under the caps."""

    def __init__(self) -> None:
        self.imports: list[tuple[str, bool]] = []
        self.names: list[str] = []
        self.defs: dict[str, str] = {}
        self.calls: set[str] = set()
        self.types: set[str] = set()
        self.links: set[str] = set()
        self.tokens: set[str] = set()

    def spec(self, text: str, reexport: bool = False, prefix: str = "") -> None:
        if text := text.strip("\"'`"):
            self.imports.append((prefix + text, reexport))

    def define(self, name: str, kind: str) -> None:
        if len(self.defs) < MAX_NAMES:
            self.defs.setdefault(name, kind)

    def add(self, to: set[str], names) -> None:
        for n in names:
            if len(n) >= SHORTEST and len(to) < MAX_NAMES:
                to.add(n)

    def result(self) -> dict:
        kept = list(dict.fromkeys(self.imports))[:MAX_IMPORTS]
        imports = [{"spec": s, "reexport": r, "names": []} for s, r in kept]
        if self.names:
            if not imports:
                imports.append({"spec": "", "reexport": False, "names": []})
            imports[0]["names"] = self.names
        return {
            "imports": imports, "calls": sorted(self.calls - set(self.defs)), "type_refs": sorted(self.types - set(self.defs)),
            "defs": [{"name": n, "kind": k} for n, k in self.defs.items()], "doc_links": sorted(self.links), "doc_tokens": sorted(self.tokens),
        }


def _blank(text: str, comment: str, strings: str) -> str:
    """The text with comments removed and string contents emptied."""
    return re.sub(f"({strings})|({comment})", lambda m: m[0][0] + m[0][0] if m[1] else " ", text, flags=re.S)


_C_COMMENT = r"//[^\n]*|/\*.*?\*/"
_C_STRING = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'
_KEYWORDS = frozenset("if for while switch catch return function await typeof new super match fn loop func defer go select range make not and or elsif unless until when yield puts case require require_relative".split())


def _calls(f: Found, text: str) -> None:
    f.add(f.calls, (m for m in re.findall(r"\b((?!\d)[\w$]+)\s*\(", text) if m not in _KEYWORDS))


def _script(f: Found, text: str, typed: bool) -> None:
    said = re.sub(_C_STRING + "|" + _C_COMMENT, lambda m: m[0] if m[0][0] in "\"'`" else " ", text, flags=re.S)
    for m in re.finditer(r"^\s*import\s+(?:type\s+)?(?:([^'\";]*?)\s+from\s+)?(['\"][^'\"\n]+['\"])", said, re.M):
        f.spec(m[2])
        if m[1]:
            braces = re.search(r"\{([^}]*)\}", m[1])
            f.names += [n.split(" as ")[0].removeprefix("type ").strip() for n in (braces[1].split(",") if braces else []) if n.strip()]
            first = m[1].split("{")[0].strip(" ,")
            if re.fullmatch(r"(?!\d)[\w$]+", first):
                f.names.append(first)
    for m in re.finditer(r"^\s*export\s+[^;'\"]*?\s*from\s+(['\"][^'\"\n]+['\"])", said, re.M):
        f.spec(m[1], True)
    for m in re.finditer(r"\brequire\(\s*(['\"][^'\"\n]+['\"])\s*\)", said):
        f.spec(m[1])
    code = _blank(text, _C_COMMENT, _C_STRING)
    for kind, pattern in (("fn", r"\bfunction\s*\*?\s*((?!\d)[\w$]+)"), ("class", r"\bclass\s+((?!\d)[\w$]+)"),
        ("interface", r"\binterface\s+((?!\d)[\w$]+)"), ("type", r"\btype\s+((?!\d)[\w$]+)\s*(?:<[^=]*>)?\s*="),
            ("enum", r"\benum\s+((?!\d)[\w$]+)"), ("const", r"^(?:export\s+)?(?:const|let|var)\s+((?!\d)[\w$]+)"),
                ("method", r"^\s+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*((?!\d)[\w$]+)\s*\([^)\n]*\)\s*(?::[^{\n]+)?\{")):
        if typed or kind not in ("interface", "type", "enum"):
            for n in re.findall(pattern, code, re.M):
                if n not in _KEYWORDS:
                    f.define(n, kind)
    _calls(f, code)
    f.add(f.calls, re.findall(r"\bnew\s+((?!\d)[\w$]+)", code))
    if typed:
        f.add(f.types, re.findall(r"(?::|\bextends|\bimplements|\bas|<|\||&|=>)\s*([A-Z][\w$]*)", code))


def _python(f: Found, text: str) -> None:
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.Import):
            for a in node.names:
                f.spec(a.name)
        elif isinstance(node, ast.ImportFrom):
            f.spec("." * node.level + (node.module or ""))
            f.names += [a.name for a in node.names if a.name != "*"]
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            f.define(node.name, "fn")
        elif isinstance(node, ast.ClassDef):
            f.define(node.name, "class")
        elif isinstance(node, ast.Call):
            f.add(f.calls, [node.func.id] if isinstance(node.func, ast.Name) else [node.func.attr] if isinstance(node.func, ast.Attribute) else [])


def _python_loose(f: Found, text: str) -> None:
    for a, b, names in re.findall(r"^\s*(?:import\s+([\w.]+)|from\s+([.\w]+)\s+import\s+([^\n#]+))", text, re.M):
        f.spec(a or b)
        f.names += [n.split(" as ")[0].strip(" ()") for n in names.split(",") if n.strip(" ()*")]
    for kind, n in re.findall(r"^\s*(?:async\s+)?(def|class)\s+(\w+)", text, re.M):
        f.define(n, "fn" if kind == "def" else "class")
    _calls(f, text)


def expand_use(text: str) -> list[tuple[str, bool]]:
    """`pub use a::{b, c::d};` as paths, each with whether it is public."""
    m = re.match(r"\s*(pub(?:\([^)]*\))?\s+)?(?:use\s+)?([^;]*)", text)
    public, under, part, out = bool(m[1]), [""], "", []

    def path(name: str) -> str:
        return "::".join(filter(None, (under[-1], name)))

    # Braces open and close a level; a comma or the end of a level completes a path.
    for token in [*re.findall(r"[{},]|[^{},]+", m[2]), ","]:
        if token == "{":
            under.append(path(part.strip().removesuffix("::")))
            part = ""
        elif token in ",}":
            if name := part.split(" as ")[0].strip():
                out.append(path(name))
            part = ""
            if token == "}" and len(under) > 1:
                under.pop()
        else:
            part += token
    return [(p, public) for p in out[: MAX_USES + 1]]


def _rust(f: Found, text: str) -> None:
    code = _blank(text, _C_COMMENT, r'"(?:\\.|[^"\\])*"')
    for u in re.findall(r"(?:pub(?:\([^)]*\))?\s+)?\buse\s+[^;]+;", code):
        for path, public in expand_use(u):
            f.spec(path, public)
    for n in re.findall(r"\bmod\s+(\w+)\s*;", code):
        f.spec(n, prefix="mod:")
    for kind, word in (("fn", "fn"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait"), ("type", "type"),
        ("static", r"static(?:\s+mut)?"), ("const", "const")):
        for n in re.findall(rf"\b{word}\s+(\w+)", code):
            if n != "fn":
                f.define(n, kind)
    for n in re.findall(r"\bmacro_rules!\s*(\w+)", code):
        f.define(n, "macro")
    _calls(f, code)
    f.add(f.calls, re.findall(r"\b(\w+)!\s*[(\[{]", code))
    f.add(f.types, re.findall(r"\b([A-Z]\w*)\b", re.sub(r"(?:pub(?:\([^)]*\))?\s+)?\buse\s+[^;]+;", "", code)))


def _go(f: Found, text: str) -> None:
    for block, one in re.findall(r"^import\s+(?:\(([^)]*)\)|(?:[\w.]+\s+)?(\"[^\"\n]+\"|`[^`\n]+`))", text, re.M | re.S):
        for s in re.findall(r"\"[^\"\n]+\"|`[^`\n]+`", block) or [one]:
            f.spec(s)
    code = _blank(text, _C_COMMENT, _C_STRING)
    for kind, pattern in (("method", r"^func\s*\([^)]*\)\s*(\w+)"), ("fn", r"^func\s+(\w+)"), ("type", r"^type\s+(\w+)"),
        ("const", r"^const\s+(\w+)"), ("var", r"^var\s+(\w+)")):
        for n in re.findall(pattern, code, re.M):
            f.define(n, kind)
    for kind, block in re.findall(r"^(const|var|type)\s*\(([^)]*)\)", code, re.M):
        for n in re.findall(r"^\s+([A-Za-z_]\w*)", block, re.M):
            f.define(n, kind)
    _calls(f, code)
    f.add(f.types, re.findall(r"(?:\*|\]|\bstruct\s*\{|\w\s+|&)([A-Z]\w*)\b(?!\s*\()", code))


def _ruby(f: Found, text: str) -> None:
    for rel, s in re.findall(r"^\s*require(_relative)?[\s(]+(['\"][^'\"\n]+['\"])", text, re.M):
        f.spec(s, prefix="rel:" if rel else "")
    code = _blank(text, r"(?<![\w\"'])#[^\n{]*", r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'')
    for kind, pattern in (("class", r"^\s*class\s+([A-Z]\w*)"), ("module", r"^\s*module\s+([A-Z]\w*)"),
        ("fn", r"^\s*def\s+(?:self\.)?(\w+)"), ("const", r"^\s*([A-Z]\w*)\s*=(?!=)")):
        for n in re.findall(pattern, code, re.M):
            f.define(n, kind)
    f.add(f.calls, (n for n in re.findall(r"(?:\.|\b)([a-z_]\w*)\s*\(", code) + re.findall(r"\.([a-z_]\w*)", code) if n not in _KEYWORDS))
    f.add(f.types, re.findall(r"\b([A-Z]\w*)\b", code))


_COFFEE_STOP = frozenset("if unless while until for switch when return throw catch require not".split())


def _coffee(f: Found, text: str) -> None:
    text = re.sub(r"###.*?###", "", text, flags=re.S)
    for line in text.split("\n"):
        if line.lstrip().startswith("#"):
            continue
        if m := re.match(r"\s*import\s+(?:(.*?)\s+from\s+)?(['\"][^'\"]+['\"])", line):
            f.spec(m[2])
            f.names += re.findall(r"(?!\d)[\w$]+", m[1] or "")
        elif m := re.match(r"\s*export\s+.*\s+from\s+(['\"][^'\"]+['\"])", line):
            f.spec(m[1], True)
        for m in re.finditer(r"(?:\{([^}]*)\}\s*=\s*)?\brequire[\s(]+(['\"][^'\"]+['\"])", line):
            f.spec(m[2])
            f.names += [n.strip() for n in (m[1] or "").split(",") if n.strip()]
        if m := re.match(r"\s*(?:module\.exports\s*=\s*|export\s+(?:default\s+)?)?class\s+(\w+)(?:\s+extends\s+([\w.]+))?", line):
            f.define(m[1], "class")
            f.add(f.types, [m[2].split(".")[-1]] if m[2] else [])
        if m := re.match(r"\s*@?((?!\d)[\w$]+)\s*[=:]\s*(?:\([^()]*\)\s*)?[=-]>", line):
            f.define(m[1], "fn")
        f.add(f.calls, (n for n in re.findall(r"\b((?!\d)[\w$]+)\(", line) if n not in _COFFEE_STOP))
        f.add(f.calls, re.findall(r"\bnew\s+((?!\d)[\w$]+)", line))


def _markdown(f: Found, text: str) -> None:
    from driftline.functions.paths import LANGS

    for target in re.findall(r"(?<=\]\()[^\s()]+(?=\))", text):
        target = target.split("#")[0]
        if target and "://" not in target and not target.startswith("mailto:") and len(f.links) < MAX_LINKS:
            f.links.add(target)
    for code in (m[0][1:-1] for m in re.finditer(r"`[^\n`]{3,120}`", text)):
        t = code.strip()
        while t.endswith("()"):
            t = t[:-2]
        if len(t) < SHORTEST or len(f.tokens) >= MAX_LINKS:
            continue
        if "/" in t or t.rsplit(".", 1)[-1].lower() in LANGS:
            f.links.add(t)
        elif re.fullmatch(r"[A-Za-z_][A-Za-z0-9_:.]*", t) and len(last := re.split(r"[:.]", t)[-1]) >= SHORTEST:
            f.tokens.add(last)


def extract(lang: str | None, content: bytes | None) -> dict:
    """The parse of one blob; empty when it is too large or can't be read."""
    f = Found()
    try:
        if content and len(content) <= MAX_BYTES:
            text = content.decode("utf-8", "replace")
            if lang in ("ts", "tsx", "js"):
                _script(f, text, lang != "js")
            elif lang == "py":
                try:
                    _python(f, text)
                except (SyntaxError, ValueError):
                    f = Found()
                    _python_loose(f, text)
            elif lang in (by := {"rust": _rust, "go": _go, "rb": _ruby, "coffee": _coffee, "md": _markdown}):
                by[lang](f, text)
    except (RecursionError, MemoryError):
        f = Found()
    return f.result()


def extract_blobs(blobs: DataFrame) -> DataFrame:
    """PARSED rows for (blob_oid, lang, content)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"blob_oid": o, "lang": k, **extract(k, c)} for o, k, c in zip(b["blob_oid"], b["lang"], b["content"], strict=True)]
            yield pd.DataFrame(rows, columns=PARSED.names)

    return blobs.select("blob_oid", "lang", "content").mapInPandas(run, PARSED)
