"""Definitions, calls and imports of PHP, TypeScript and JavaScript, read from tokens.

A reader of tokens and braces, not a full parser: it knows comments, strings, heredocs, regex and template
literals, declarations, receivers and imports. What it doesn't see: calls inside the expressions of strings
and templates, and definitions that are values (arrow functions, function expressions, anonymous classes).
"""

from __future__ import annotations

import posixpath
import re
from typing import NamedTuple

CLASS_KINDS = ("class", "interface", "trait", "enum")


class Token(NamedTuple):
    """kind: w word, v variable, s string, n number, p punctuation."""

    kind: str
    text: str
    line: int


_SHARED = r"(?P<gap>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`)|(?P<n>\d[\w.]*)"
_PHP = re.compile(r"(?P<hash>\#(?!\[)[^\n]*)|(?P<here><<<[ \t]*['\"]?(?P<tag>\w+)['\"]?\n.*?\n[ \t]*(?P=tag)\b)|(?P<out>\?>.*?(?:<\?php\b|<\?=|\Z))|" + _SHARED + r"|(?P<v>\$\w+)|(?P<w>[^\W\d][\w\\]*|\\[\w\\]+)|(?P<p>\?->|->|::|=>|.)", re.S)
_JS = re.compile(_SHARED + r"|(?P<w>[#@]?[^\W\d$][\w$]*|\$[\w$]*)|(?P<p>\?\.|=>|\.\.\.|.)", re.S)
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%<>~^") | {"return", "typeof", "case", "=>", "in", "of"}
_CONTROL = {"if", "for", "foreach", "while", "switch", "catch", "match", "function", "fn", "array", "list", "isset", "unset", "empty", "exit", "die", "echo", "print", "return", "include", "include_once", "require", "require_once", "and", "or", "xor", "not", "declare", "use", "new", "typeof", "await", "yield", "delete", "void", "in", "of", "instanceof", "throw", "case", "else", "elseif", "do", "with", "import", "export", "super", "clone"}
_MODIFIERS = {"public", "private", "protected", "static", "abstract", "final", "readonly", "async", "export", "default", "declare", "get", "set", "override"}


def tokens(text: str, lang: str) -> list[Token]:
    out: list[Token] = []
    at = 0
    if lang == "php":
        m = re.search(r"<\?php\b|<\?=", text)
        if not m:
            return out
        at = m.end()
    line = text.count("\n", 0, at) + 1
    while at < len(text):
        m = None
        if lang != "php" and text[at] == "/" and (not out or out[-1].text in _BEFORE_REGEX):
            m = _REGEX.match(text, at)
        if m:
            out.append(Token("s", "/", line))
        else:
            m = (_PHP if lang == "php" else _JS).match(text, at)
            kind = m.lastgroup
            if m.groupdict().get("here") is not None:
                out.append(Token("s", "<<<", line))
            elif kind in ("s", "n", "v", "w", "p"):
                out.append(Token(kind, m.group(), line))
            elif kind == "out":
                out.append(Token("p", ";", line))
        line += m.group().count("\n")
        at = m.end()
    return out


def _leaf(name: str) -> str:
    return name.rstrip("\\").rsplit("\\", 1)[-1].lstrip("$")


def _close(t: list[Token], at: int, opens: str, closes: str) -> int:
    """Position of the bracket that closes the one at `at`; the end if none does."""
    depth = 0
    for i in range(at, len(t)):
        if t[i].kind == "p" and t[i].text in (opens, closes):
            depth += 1 if t[i].text == opens else -1
            if not depth:
                return i
    return len(t)


def _word(t: list[Token], i: int, *texts: str) -> bool:
    return 0 <= i < len(t) and t[i].kind in ("w", "p") and (t[i].text in texts)


def _bases(t: list[Token], a: int, b: int) -> list[str]:
    """Names after extends and implements, without type arguments."""
    out, on, depth, last = [], False, 0, ""
    for x in t[a:b]:
        if x.text in "<>" and x.kind == "p":
            depth += 1 if x.text == "<" else -1
        elif depth:
            continue
        elif x.kind == "w" and x.text in ("extends", "implements"):
            out += [last] if on and last else []
            on, last = True, ""
        elif on and x.text == ",":
            out += [last] if last else []
            last = ""
        elif on and x.kind == "w":
            last = _leaf(x.text)
    return [*out, last] if on and last else out


def _starts(t: list[Token], i: int) -> int:
    """Position of the first modifier before the declaration at i."""
    while i > 0 and t[i - 1].kind == "w" and t[i - 1].text in _MODIFIERS - {"export", "default", "declare"}:
        i -= 1
    return i


def _imports(t: list[Token], lang: str, file_dir: str) -> list[dict]:
    out: list[dict] = []
    depth = base = 0
    i = 0
    while i < len(t):
        x = t[i]
        depth += (x.text == "{") - (x.text == "}") if x.kind == "p" else 0
        if lang == "php" and x.kind == "w" and x.text == "namespace":
            j = i
            while j < len(t) and t[j].text not in ("{", ";"):
                j += 1
            base = depth + 1 if _word(t, j, "{") else depth
        if lang == "php" and x.kind == "w" and x.text == "use" and depth <= base and not _word(t, i - 1, ")"):
            end = next((j for j in range(i, len(t)) if t[j].text == ";"), len(t))
            words = [w for w in t[i + 1 : end] if not (w.kind == "w" and w.text in ("function", "const"))]
            head = ""
            if any(w.text == "{" for w in words):
                k = next(j for j, w in enumerate(words) if w.text == "{")
                head, words = "".join(w.text for w in words[:k]).strip("\\") + "\\", [w for w in words[k + 1 :] if w.text != "}"]
            clause: list[str] = []
            for w in [*words, Token("p", ",", 0)]:
                if w.text != ",":
                    clause.append(w.text)
                    continue
                if clause:
                    fqn = (head + clause[0]).strip("\\")
                    out.append({"fact": "import", "alias": clause[2] if len(clause) > 2 and clause[1] == "as" else _leaf(fqn), "fqn": fqn})
                clause = []
            i = end
            continue
        if lang != "php" and x.kind == "w" and x.text == "import" and depth == 0 and not _word(t, i + 1, "(", "."):
            end = next((j for j in range(i + 1, len(t)) if t[j].kind == "s" or t[j].text == ";"), len(t))
            source = t[end].text.strip("'\"") if end < len(t) and t[end].kind == "s" else ""
            if source.startswith("."):
                rel = posixpath.normpath(posixpath.join(file_dir, source))
                words = [w for w in t[i + 1 : end] if w.text not in ("type",)]
                if words and words[0].kind == "w" and words[0].text != "from":
                    out.append({"fact": "import", "alias": words[0].text, "name": "default", "rel": rel})
                inner: list[str] = []
                opened = False
                for w in words:
                    if w.text == "{":
                        opened = True
                    elif opened and w.text in (",", "}"):
                        if inner:
                            out.append({"fact": "import", "alias": inner[-1] if len(inner) == 3 and inner[1] == "as" else inner[0], "name": inner[0], "rel": rel})
                        inner = []
                        opened = w.text == ","
                    elif opened:
                        inner.append(w.text)
            i = end
        i += 1
    return out


def read(text: str, path: str, lang: str) -> list[dict]:
    """Facts of a file, as graph.facts_of gives them for Python; each has its namespace `ns`."""
    t = tokens(text, lang)
    php, ns = lang == "php", ""
    if php:
        at = next((i for i, x in enumerate(t) if x.kind == "w" and x.text == "namespace" and i + 1 < len(t) and t[i + 1].kind == "w"), None)
        ns = t[at + 1].text.strip("\\") if at is not None else ""
    out = _imports(t, lang, posixpath.dirname(path))
    open_: list[tuple[int, dict]] = []  # (depth of its braces, definition)
    waiting: dict[int, dict] = {}  # by the position of the brace that opens it
    depth, i = 0, 0
    skip_until = -1  # the header of a declaration has no calls of its own

    def scope() -> tuple[str, str]:
        names = [d["name"] for _, d in open_]
        cls = next((d["qname"] for _, d in reversed(open_) if d["kind"] in CLASS_KINDS), "")
        return ".".join(names), cls

    def define(name: str, kind: str, start: int, body: int, bases: list[str] | None) -> None:
        d = {"fact": "def", "name": name, "qname": ".".join([*(x["name"] for _, x in open_), name]), "kind": kind, "start_line": t[start].line, "end_line": t[min(body, len(t) - 1)].line, "bases": bases}
        out.append(d)
        if body < len(t) and t[body].text == "{":
            waiting[body] = d

    def body_after(j: int) -> int:
        """The brace that opens the body of what is declared, or the end of what has none."""
        while j < len(t) and not (t[j].kind == "p" and t[j].text in ("{", ";", "}")):
            if t[j].text in ("(", "["):
                j = _close(t, j, t[j].text, ")" if t[j].text == "(" else "]")
            j += 1
        return j

    while i < len(t):
        x, prev = t[i], t[i - 1] if i else Token("p", ";", 0)
        in_class = bool(open_) and open_[-1][1]["kind"] in CLASS_KINDS and open_[-1][0] == depth
        if x.kind == "p" and x.text == "{":
            depth += 1
            if i in waiting:
                open_.append((depth, waiting.pop(i)))
        elif x.kind == "p" and x.text == "}":
            if open_ and open_[-1][0] == depth:
                open_.pop()[1]["end_line"] = x.line
            depth -= 1
        elif x.kind == "w" and x.text in CLASS_KINDS and i + 1 < len(t) and t[i + 1].kind == "w" and t[i + 1].text not in ("extends", "implements") and not _word(t, i - 1, "new", "->", "::", ".", "?.") and (php or x.text != "trait"):
            body = next((j for j in range(i, len(t)) if t[j].text in ("{", ";")), len(t))
            if body < len(t) and t[body].text == "{" and not (not php and prev.text in ("=", "(", ",", "return", ":")):
                define(t[i + 1].text, x.text, _starts(t, i), body, _bases(t, i + 2, body))
                i = skip_until = body - 1
        elif x.kind == "w" and x.text == "function" and not _word(t, i - 1, "->", "::", ".", "use") and (php or prev.text in (";", "{", "}", ")", "export", "default", "async") or i == 0):
            j = i + 1
            while _word(t, j, "&", "*"):
                j += 1
            if j + 1 < len(t) and t[j].kind == "w" and t[j + 1].text in ("(", "<"):
                define(t[j].text, "method" if php and in_class else "function", _starts(t, i), body_after(j + 1), None)
                i = j
        elif php and x.text == "use" and in_class and x.kind == "w":
            end = next((j for j in range(i, len(t)) if t[j].text in (";", "{")), len(t))
            open_[-1][1]["bases"] += [_leaf(w.text) for w in t[i + 1 : end] if w.kind == "w"]
            i = end - 1
        elif x.kind == "w" and x.text == "new" and i + 1 < len(t) and t[i + 1].kind == "w" and t[i + 1].text not in ("class", "static", "self", "parent", "function"):
            j = i + 1
            while not php and j + 2 < len(t) and t[j + 1].text == "." and t[j + 2].kind == "w":
                j += 2
            caller, cls = scope()
            out.append({"fact": "call", "callee": "__construct", "rkind": "new", "rclass": _leaf(t[j].text), "caller": caller, "class": cls, "start_line": x.line})
            i = j
        elif x.kind in ("w", "v") and i + 1 < len(t) and t[i + 1].text == "(" and t[i + 1].kind == "p":
            name, end = _leaf(x.text), _close(t, i + 1, "(", ")")
            dotted = prev.text in (".", "?.", "->", "::")
            typed = not php and end + 1 < len(t) and t[end + 1].text == ":" and in_class
            body = body_after(end + 1) if typed else end + 1
            if not php and not dotted and x.text not in _CONTROL and x.kind == "w" and body < len(t) and t[body].text == "{" and (in_class or prev.text in ("{", ",", "get", "set", "async", "*")):
                define(x.text, "method", _starts(t, i), body, None)
            else:
                call = _call(t, i, name, php)
                if call:
                    caller, cls = scope()
                    out.append({"fact": "call", **call, "caller": caller, "class": cls, "start_line": x.line})
        i += 1
    return [{**f, "ns": ns} for f in out]


def _call(t: list[Token], i: int, name: str, php: bool) -> dict | None:
    """Callee and receiver of the call whose name is at i; None if it isn't a call."""
    prev = t[i - 1].text if i else ""
    base = t[i - 2] if i > 1 else Token("p", "", 0)
    before = t[i - 3].text if i > 2 else ""
    if php:
        if prev == "->":
            own = base.text == "$this" and before not in ("->", "::", "?->")
            return {"callee": name, "rkind": "this" if own else "member", "rclass": ""}
        if prev == "::":
            kind = {"self": "self", "static": "self", "parent": "parent"}.get(base.text, "static")
            return {"callee": name, "rkind": kind, "rclass": _leaf(base.text) if kind == "static" else ""}
        if prev in ("function", "fn", "new", "?->") or t[i].text.lower() in _CONTROL or t[i].kind == "v":
            return None
        return {"callee": name, "rkind": "free", "rclass": ""}
    if prev in (".", "?."):
        own = base.text in ("this", "self") and before not in (".", "?.")
        return {"callee": name, "rkind": "this" if own else "member", "rclass": ""}
    if prev in ("function", "new") or (t[i].text in _CONTROL and t[i].text != "super"):
        return None
    return {"callee": t[i].text, "rkind": "free", "rclass": ""}


def top_level(text: str, lang: str) -> list[tuple[int, int]]:
    """(first line - 1, last line) of the definitions at the top, in order; for TypeScript and JavaScript also exports and let or const."""
    t = tokens(text, lang)
    out: list[tuple[int, int]] = []
    i, php = 0, lang == "php"
    while i < len(t):
        x = t[i]
        if x.kind == "w" and (x.text in CLASS_KINDS or x.text in ("function", "abstract", "final", "readonly", "async") or (not php and x.text in ("export", "const", "let"))):
            value = not php and (x.text in ("const", "let") or (x.text == "export" and _word(t, i + 1, "const", "let", "default", "{", "*", "type")))
            j = i
            while j < len(t) and not (t[j].kind == "p" and (t[j].text == ";" or (t[j].text == "{" and not value))):
                closes = {"(": ")", "[": "]", "{": "}"}.get(t[j].text) if t[j].kind == "p" else None
                j = _close(t, j, t[j].text, closes) if closes else j
                if value and j + 1 < len(t) and t[j + 1].line > t[min(j, len(t) - 1)].line and t[min(j, len(t) - 1)].text in (")", "]", "}") and t[j + 1].text not in (".", ",", "=", "?", ":", "+", "-", "&", "|", ")"):
                    break  # no semicolon at the line's end
                j += 1
            end = _close(t, j, "{", "}") if j < len(t) and t[j].text == "{" and not value else j
            out.append((x.line - 1, t[min(end, len(t) - 1)].line))
            i = end
        elif x.kind == "p" and x.text in ("{", "(", "["):
            i = _close(t, i, x.text, {"{": "}", "(": ")", "[": "]"}[x.text])
        i += 1
    return out
