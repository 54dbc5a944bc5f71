"""Symbols of source files, by a table of patterns for each language. An Arrow function gives them as an array of structs.

A rule names what a line declares. Rules of a language are tried in order and the first that fits a line wins. Bodies of
functions aren't parsed; nesting is told by indentation and, where it matters, by braces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SYMBOLS = "array<struct<name: string, kind: string, signature: string, line: int, end_line: int, source_module: string, source_name: string>>"
NOT_NAMES = frozenset("if for while switch catch return throw await new super this const let var else do try elif with".split())


@dataclass(frozen=True)
class Symbol:
    name: str
    kind: str
    signature: str
    line: int
    end_line: int | None = None
    source_module: str | None = None
    source_name: str | None = None


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    kind: str | Callable[[re.Match, bool], str]
    nested: bool | None = None  # only indented lines, only others, or both
    needs: str | None = None  # must be in the signature


def _rule(pattern: str, kind, nested: bool | None = None, needs: str | None = None) -> Rule:
    return Rule(re.compile(pattern), kind, nested, needs)


_JS = r"(?:export\s+)?(?:default\s+)?"
_VIS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|synchronized|async|virtual|override|readonly|unsafe|extern|new)\s+)*"
_by_nesting = lambda m, nested: "method" if nested else "function"
_SCRIPT = (
    _rule(rf"{_JS}(?:async\s+)?function\*?\s+(?P<n>\w+)", "function"),
    _rule(rf"{_JS}(?:abstract\s+)?class\s+(?P<n>\w+)", "class"),
    _rule(rf"{_JS}interface\s+(?P<n>\w+)", "interface"),
    _rule(rf"{_JS}(?:const\s+)?enum\s+(?P<n>\w+)", "enum"),
    _rule(rf"{_JS}type\s+(?P<n>\w+)(?:<[^=]*>)?\s*=", "type"),
    _rule(rf"{_JS}const\s+(?P<n>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\(|\w+\s*=>)", "function", needs="=>"),
    _rule(r"(?:(?:public|private|protected|static|abstract|override|readonly|async)\s+)*(?:get|set)\s+(?P<n>[\w$]+)\s*\(", "method", nested=True),
    _rule(r"(?:(?:public|private|protected|static|abstract|override|readonly|async)\s+)*\*?(?P<n>[A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\([^)]*\)\s*(?:(?::[^={;]+)?\{|:[^={;]+;\s*$)", "method", nested=True),
    _rule(rf"{_JS}const\s+(?P<n>[A-Z][A-Z0-9_]+)\s*(?::[^=]+)?=", "constant", nested=False),
    _rule(rf"{_JS}const\s+(?P<n>\w+)\s*:\s*[^=]+=", "variable", nested=False),
)
_PYTHON = (
    _rule(r"(?:async\s+)?def\s+(?P<n>\w+)", _by_nesting),
    _rule(r"class\s+(?P<n>\w+)", "class"),
    _rule(r"(?P<n>[A-Z][A-Z0-9_]+)\s*(?::[^=]+)?=(?!=)", "constant", nested=False),
)
_PUB = r"(?:pub(?:\([^)]*\))?\s+)?"
_RUST = (
    _rule(rf"{_PUB}(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+(?P<n>\w+)", _by_nesting),
    _rule(rf"{_PUB}(?P<k>struct|enum|trait)\s+(?P<n>\w+)", lambda m, _: {"struct": "class", "enum": "enum", "trait": "interface"}[m["k"]]),
    _rule(rf"{_PUB}(?P<k>static|const)\s+(?:mut\s+)?(?P<n>\w+)\s*:", lambda m, _: "constant" if m["k"] == "const" else "variable"),
    _rule(rf"{_PUB}type\s+(?P<n>\w+)(?:<[^=]*>)?\s*=", "type"),
)
_GO = (
    _rule(r"func\s+(?P<r>\([^)]*\)\s*)?(?P<n>\w+)", lambda m, _: "method" if m["r"] else "function"),
    _rule(r"type\s+(?P<n>\w+)\s+(?P<b>interface\b)?", lambda m, _: "interface" if m["b"] else "class"),
    _rule(r"(?P<k>const|var)\s+(?P<n>\w+)[^=]*=", lambda m, _: "constant" if m["k"] == "const" else "variable"),
)
_JVM = (
    _rule(rf"{_VIS}(?P<k>class|interface|enum|record|struct)\s+(?P<n>\w+)", lambda m, _: m["k"] if m["k"] in ("interface", "enum") else "class"),
    _rule(rf"{_VIS}[\w<>,.?\[\]]+(?:\s*<[^(]*>)?(?:\[\])?\s+(?P<n>\w+)\s*\([^)]*\)\s*(?:throws\s+[\w.,\s]+)?(?:\{{|=>|;|$)", "method", nested=True),
)
_C = (
    _rule(r"(?:typedef\s+)?(?:class|struct)\s+(?P<n>\w+)(?!.*;\s*$)", "class"),
    _rule(r"enum\s+(?:class\s+)?(?P<n>\w+)", "enum"),
    _rule(r"[A-Za-z_][\w:<>,&*\s]*[\s&*](?:\w+::)*(?P<n>[A-Za-z_]\w*)\s*\([^)]*\)\s*(?:const|noexcept|override|\s)*(?:[{;]|$)", _by_nesting),
)
_RUBY = (_rule(r"(?:class|module)\s+(?P<n>[\w:]+)", "class"), _rule(r"def\s+(?P<n>[\w!?=.]+)", "method"))
_PHP = (
    _rule(r"(?:abstract\s+|final\s+)?(?P<k>class|interface|trait)\s+(?P<n>\w+)", lambda m, _: "interface" if m["k"] == "interface" else "class"),
    _rule(r"(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(?P<n>\w+)\s*\(", _by_nesting),
)
_SHELL = (_rule(r"function\s+(?P<n>\w+)\s*(?:\(\))?\s*\{?\s*$", "function"), _rule(r"(?P<n>\w+)\s*\(\)\s*\{?", "function"))
LANGUAGES: dict[str, tuple[Rule, ...]] = {
    **dict.fromkeys((".ts", ".tsx", ".js", ".jsx"), _SCRIPT), ".py": _PYTHON, ".rs": _RUST, ".go": _GO, **dict.fromkeys((".java", ".cs"), _JVM),
    **dict.fromkeys((".c", ".cpp", ".h", ".hpp"), _C), ".rb": _RUBY, ".php": _PHP, **dict.fromkeys((".sh", ".bash"), _SHELL),
}
_TEST_BLOCK = re.compile(r"""^\s*(?P<f>describe|it|test|suite|context)(?:\.\w+)*\s*\(\s*(?P<q>["'`])(?P<t>.*?)(?P=q)""")
_IMPORTED = re.compile(r"""(?:import|export)\s*(?:type\s+)?(?:[\w$]+\s*,\s*)?\{(?P<l>[^}]*)\}\s*(?:from\s*["'](?P<m>[^"']+)["'])?""")
_STAR = re.compile(r"""(?:import|export)\s*\*\s*as\s+(?P<n>\w+)\s*from\s*["'](?P<m>[^"']+)["']""")
_FROM = re.compile(r"(?m)^from\s+(?P<m>[.\w]+)\s+import\s+(?:\((?P<p>[^)]*)\)|(?P<l>.+))$")
_AS = re.compile(r"^(\w+)\s+as\s+(\w+)$")
_IMPORT_AS = re.compile(r"^import\s+(?P<m>[.\w]+)\s+as\s+(?P<n>\w+)")
_PY_TOKEN = re.compile(r"""(?s)(?P<q>'''|\"\"\")(?P<t>(?:\\.|(?!(?P=q))[^\\])*+)(?P=q)|\#[^\n]*|'(?:\\.|[^'\\\n])*+'|"(?:\\.|[^"\\\n])*+\"""")
_ASSIGNED = re.compile(r"^(?P<n>[A-Za-z_]\w*)\s*=\s*(?P<o>[A-Za-z_]\w*)\s*$")


def signature(lines: list[str], at: int, most: int = 20) -> str:
    """The declaration from its line to where its body begins, brackets balanced, on one line; ``most`` lines at most."""
    out, depth = [], 0
    for line in lines[at : at + most]:
        for i, c in enumerate(line):
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif depth <= 0 and (c in "{;" or (c == ":" and line[i + 1 :].strip() in ("", "...", "pass"))):
                out.append(line[:i])
                return " ".join(" ".join(out).split()).removeprefix("export ")
        out.append(line)
        if depth <= 0:
            break
    return " ".join(" ".join(out).split()).removeprefix("export ")


def _aliases(ext: str, text: str, lines: list[str]) -> Iterator[Symbol]:
    line_of = lambda at: text.count("\n", 0, at) + 1
    found: list[tuple[int, str | None, str]] = []
    if LANGUAGES.get(ext) is _SCRIPT:
        found = [(m.start(), m["m"], m["l"]) for m in _IMPORTED.finditer(text)]
        for m in _STAR.finditer(text):
            yield Symbol(m["n"], "alias", m[0], line_of(m.start()), source_module=m["m"], source_name="*")
    elif ext == ".py":
        found = [(m.start(), m["m"], m["p"] or m["l"] or "") for m in _FROM.finditer(text)]
    for at, module, names in found:
        for name in names.split(","):
            if m := _AS.match(" ".join(name.split("#")[0].split())):
                yield Symbol(m[2], "alias", f"{m[1]} as {m[2]}", line_of(at), source_module=module, source_name=m[1])
    if ext == ".py":
        for i, line in enumerate(lines):
            if m := _IMPORT_AS.match(line):
                yield Symbol(m["n"], "alias", line.strip(), i + 1, source_module=m["m"], source_name=m["m"])
            elif (m := _ASSIGNED.match(line)) and m["o"] not in ("None", "True", "False") and not m["n"].isupper():
                yield Symbol(m["n"], "alias", line.strip(), i + 1, source_name=m["o"])


def _arrow_signature(lines: list[str], at: int) -> str:
    text = " ".join(" ".join(lines[at : at + 20]).split())
    head, arrow, _ = text.partition("=>")
    return f"{head}{arrow}".removeprefix("export ")


def _without_strings(text: str) -> str:
    """Python code without what stands in triple-quoted strings; its line ends stay. A string that isn't closed stays whole."""
    return _PY_TOKEN.sub(lambda m: m[0] if not m["q"] else m["q"] + "\n" * m["t"].count("\n") + m["q"], text)


def symbols_of(path: str, text: str, is_test: bool = False) -> list[Symbol]:
    """Declarations and aliases by line; test blocks too in test files. Triple-quoted strings of Python declare nothing."""
    ext = re.sub(r"^.*(?=\.)|^[^.]*$", "", path.replace("\\", "/").rsplit("/", 1)[-1]).lower()
    rules = LANGUAGES.get(ext, ())
    if rules is _PYTHON:
        text = _without_strings(text)
    lines, out = text.split("\n"), []
    for i, raw in enumerate(lines):
        line = raw.strip()
        nested = raw[:1].isspace()
        if not line or line[:2] in ("//", "/*", "* ") or (line[0] == "#" and rules in (_PYTHON, _RUBY, _SHELL)):
            continue
        if is_test and rules is _SCRIPT and (m := _TEST_BLOCK.match(raw)):
            out.append(Symbol(m["t"], "test", f"{m['f']}({m['q']}{m['t']}{m['q']})", i + 1))
            continue
        for rule in rules:
            m = rule.pattern.match(line)
            if not m or m["n"] in NOT_NAMES or (rule.nested is not None and rule.nested != nested):
                continue
            if line.split("(")[0].split(" ")[0] in NOT_NAMES and rule.kind == "method":
                continue
            sig = _arrow_signature(lines, i) if rule.needs else signature(lines, i)
            if rule.needs and rule.needs not in sig:
                continue
            kind = rule.kind if isinstance(rule.kind, str) else rule.kind(m, nested)
            out.append(Symbol(m["n"], kind, sig, i + 1))
            break
    out += _aliases(ext, text, lines)
    return sorted(out, key=lambda s: s.line)


def _extract(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for paths, texts, tests in it:
        yield pd.Series([[vars(s) | {} for s in symbols_of(p, t or "", bool(x))] for p, t, x in zip(paths, texts, tests, strict=True)])


def extracted(path: Column | str, content: Column | str, is_test: Column) -> Column:
    return F.pandas_udf(_extract, SYMBOLS)(path, content, is_test)
