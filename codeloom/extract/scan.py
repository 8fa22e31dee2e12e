"""Symbols, imports and usages of one source text.

A declaration scan over positioned tokens with a stack of open brackets; no
syntax tree, so files with errors still give what can be seen.  Declarations
inside a callable are dropped, except in C#, whose scan only looks at the
members of types.  Lines are 1-based, columns 0-based UTF-8 bytes.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

from codeloom.lex.scanner import IDENT, NEWLINE, STR, clean, scanner

_CLOSE = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Parsed:
    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)


class Tokens:
    """Token texts, kinds and places of a text."""

    def __init__(self, text: str, language: str):
        s = scanner(language)
        self.shift = language == "python"
        self.text = clean(text, language)
        self.breaks = [k for k, c in enumerate(self.text) if c == "\n"]
        self.t, self.k, self.at = [], [], []
        for at, token, kinds in s.places(self.text):
            self.t.append(token)
            # keywords in one place only, names elsewhere
            self.k.append(IDENT if language == "rust" and token in ("raw", "union") else kinds)
            self.at.append(at)
        self.n = len(self.t)
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.t):
            if t in _CLOSE:
                stack.append(i)
            elif t in (")", "]", "}"):
                while stack and _CLOSE[self.t[stack[-1]]] != t:
                    stack.pop()
                if stack:
                    self.match[stack.pop()] = i

    def tok(self, i: int) -> str:
        return self.t[i] if 0 <= i < self.n else ""

    def is_id(self, i: int) -> bool:
        return 0 <= i < self.n and self.k[i] == IDENT

    def place(self, i: int) -> tuple[int, int]:
        return self.place_at(self.at[i])

    def place_at(self, at: int) -> tuple[int, int]:
        row = bisect.bisect_left(self.breaks, at)
        start = self.breaks[row - 1] + 1 if row else 0
        return row + (0 if self.shift else 1), len(self.text[start:at].encode("utf-8", "surrogatepass"))

    def end_line(self, i: int) -> int:
        return bisect.bisect_left(self.breaks, self.at[i] + len(self.t[i].rstrip()) - 1) + (0 if self.shift else 1)

    def after(self, i: int) -> int:
        """Index behind the bracket that opens at ``i`` (or behind ``i``)."""
        return self.match.get(i, i) + 1

    def skip(self, i: int) -> int:
        while i < self.n and self.k[i] == NEWLINE:
            i += 1
        return i

    def prev(self, i: int) -> str:
        i -= 1
        while i >= 0 and self.k[i] == NEWLINE:
            i -= 1
        return self.tok(i)

    def angles(self, i: int) -> int:
        """Index behind a ``<...>`` list at ``i``."""
        if self.tok(i) != "<":
            return i
        depth = 0
        while i < self.n:
            t = self.t[i]
            depth += (t == "<") - (t == ">")
            if t in _CLOSE:
                i = self.after(i) - 1
            elif t in (";", "{"):
                return i
            i += 1
            if not depth:
                break
        return i


class Scan:
    """Base: walks the tokens; languages add declarations at ``at``."""

    def __init__(self, text: str, language: str):
        self.x = Tokens(text, language)
        self.out = Parsed()
        self.frames: list[tuple[int, str, str | None]] = []  # closing index, kind, name
        self.pending: dict[int, tuple[str, str | None]] = {}  # opening index -> kind, name

    def run(self) -> Parsed:
        x, i = self.x, 0
        while i < x.n:
            while self.frames and i >= self.frames[-1][0]:
                self.frames.pop()
            if x.t[i] in _CLOSE:
                kind, name = self.pending.pop(i, (self.opened(i), None))
                self.frames.append((x.match.get(i, x.n), kind, name))
            else:
                self.at(i)
            i += 1
        return self.out

    def opened(self, i: int) -> str:
        return "block"

    def at(self, i: int) -> None:
        raise NotImplementedError

    def local(self) -> bool:
        return any(f[1] == "callable" for f in self.frames)

    def scope(self, kinds: tuple[str, ...]) -> str | None:
        return next((n for _, k, n in reversed(self.frames) if k in kinds and n), None)

    def symbol(self, i: int, kind: str, end: int, visibility: str, scope: str | None, name: str | None = None) -> None:
        line, column = self.x.place(i)
        self.out.symbols.append(
            {"name": name or self.x.t[i].strip("`"), "kind": kind, "line": line, "column": column, "end_line": max(line, self.x.end_line(min(end, self.x.n - 1))), "visibility": visibility, "scope": scope}
        )

    def ref(self, i: int, qualified: bool, scope: str | None = None, name: str | None = None) -> None:
        line, column = self.x.place(i)
        self.out.references.append({"symbol_name": name or self.x.t[i], "line": line, "column": column, "from_scope": scope, "qualified": qualified})

    def imp(self, path: str, names: list[str] = (), alias: str | None = None) -> None:
        if path:
            self.out.imports.append({"import_path": path, "alias": alias, "names": list(names)})

    def body(self, i: int, stops: tuple[str, ...] = (";",)) -> tuple[int, int | None]:
        """(last index, opening brace or None) of a declaration whose header runs on from ``i``."""
        x = self.x
        while i < x.n:
            t = x.t[i]
            if t == "{":
                return x.match.get(i, x.n - 1), i
            if t in stops or t == "}":
                return (i if t != "}" else i - 1), None
            i = x.after(i) if t in _CLOSE else i + 1
        return x.n - 1, None

    def line_end(self, i: int) -> int:
        """Last index of a statement that ends with ``;`` or its line."""
        x = self.x
        while i < x.n:
            t = x.t[i]
            if t == ";" or t == "}":
                return i if t == ";" else i - 1
            if x.k[i] == NEWLINE and x.tok(i - 1) not in ("=", ",", "=>", "(", "[", "{", "+", "|", "&", "&&", "||", "?", ":") and x.tok(i + 1) not in (".", "?", ":", "|", "&", "&&", "||", "+", "=>", "?."):
                return i - 1
            i = x.after(i) if t in _CLOSE else i + 1
        return x.n - 1


class Python(Scan):
    def run(self) -> Parsed:
        x = self.x
        blocks: list[tuple[int, str, dict | None, str]] = []  # indent, kind, symbol, name
        i, last = 0, -1

        def close(width: int) -> None:
            while blocks and blocks[-1][0] >= width:
                b = blocks.pop()
                if b[2] is not None and last >= 0:
                    b[2]["end_line"] = x.end_line(last)

        while i < x.n:
            if x.t[i][0] == "\n":
                while i < x.n and x.t[i][0] == "\n":
                    i += 1
                if i == x.n:
                    break
                width = len(x.t[i - 1][1:].expandtabs(8))
                close(width)
                self._statement(i, width, blocks)
            j = i
            while j < x.n and x.t[j][0] != "\n":
                t = x.t[j]
                if x.is_id(j) and x.tok(j + 1) == "(" and x.tok(j - 1) not in ("def", "class"):
                    self.ref(j, x.tok(j - 1) == ".")
                if t == ";" or (t == ":" and x.tok(j + 1) in ("def", "class", "import", "from")):
                    self._statement(j + 1, 10**6, blocks)
                last = j
                if t in _CLOSE and j in x.match:  # a logical line runs on inside brackets
                    for q in range(j + 1, x.match[j]):
                        if x.is_id(q) and x.tok(q + 1) == "(":
                            self.ref(q, x.tok(q - 1) == ".")
                    j = x.match[j]
                    last = j
                j += 1
            i = max(j, i + 1) if j == i else j
        close(-1)
        for i, t in enumerate(x.t):
            if t[-1] in "\"'" and len(t) > 4:
                self._interpolated(t, x.at[i])
        return self.out

    def _interpolated(self, t: str, at: int) -> None:
        """Calls in the expressions of a string that begins at ``at``."""
        s = scanner("python", True)
        for start, text in s.expressions(t):
            tokens = s.places(text)
            for k, (a, name, kinds) in enumerate(tokens):
                here = at + start + a
                if kinds[:1] == STR:
                    self._interpolated(name, here)
                elif kinds == IDENT and k + 1 < len(tokens) and tokens[k + 1][1] == "(":
                    line, column = self.x.place_at(here)
                    self.out.references.append({"symbol_name": name, "line": line, "column": column, "from_scope": None, "qualified": k > 0 and tokens[k - 1][1] == "."})

    def _statement(self, i: int, width: int, blocks: list) -> None:
        x = self.x
        local = any(b[1] == "def" for b in blocks)
        scope = next((b[3] for b in reversed(blocks) if b[1] == "class"), None)
        j = i + (x.tok(i) == "async")
        if x.tok(j) in ("def", "class") and x.is_id(j + 1):
            name, sym = x.t[j + 1], None
            if not local:
                vis = "private" if name.startswith("__") and not name.endswith("__") else "protected" if name.startswith("_") else "pub"
                self.symbol(j + 1, "fn" if x.t[j] == "def" else "class", j + 1, vis, scope)
                sym = self.out.symbols[-1]
            blocks.append((width, x.t[j], sym, name))
        elif x.is_id(i) and width == 0 and not blocks and x.tok(i + 1) in ("=", ":") and all(c.isupper() or c == "_" for c in x.t[i]):
            e, ends = i, i
            seen = x.tok(i + 1) == "="
            while e < x.n and x.t[e][0] != "\n" and x.t[e] != ";":
                seen = seen or x.t[e] == "="
                ends = e if x.t[e] not in _CLOSE else x.after(e) - 1
                e = x.after(e)
            if seen:
                self.symbol(i, "const", ends, "pub", None)
        elif x.tok(i) == "import":
            j = i + 1
            while x.is_id(j):
                path = x.t[j]
                j += 1
                while x.tok(j) == "." and x.is_id(j + 1):
                    path += "." + x.t[j + 1]
                    j += 2
                if x.tok(j) == "as":
                    j += 2
                else:
                    self.imp(path)
                if x.tok(j) != ",":
                    break
                j += 1
        elif x.tok(i) == "from":
            j, path = i + 1, ""
            while x.tok(j) in (".", "...") or x.is_id(j):
                path += x.t[j]
                j += 1
            if x.tok(j) == "import":
                j += 1
                stop = x.match.get(j, x.n) if x.tok(j) == "(" else x.n
                j += x.tok(j) == "("
                names = []
                while j < stop and (x.t[j][0] != "\n" or stop < x.n):
                    if x.is_id(j):
                        if x.tok(j + 1) == "as" and x.is_id(j + 2):
                            j += 2
                        names.append(x.t[j])
                    elif x.t[j] not in (",", "*") and x.t[j][0] != "\n":
                        break
                    j += 1
                self.imp(path, names)


class Rust(Scan):
    _MODS = ("const", "async", "unsafe", "extern", "default")

    def _public(self, i: int) -> bool:
        x, j = self.x, i - 1
        while j >= 0 and (x.t[j] in self._MODS or x.k[j] == STR):
            j -= 1
        if x.tok(j) == ")":
            j = next((o - 1 for o, c in x.match.items() if c == j), j)
        return x.tok(j) == "pub"

    def _impl_name(self, i: int) -> str | None:
        x, j, names = self.x, self.x.angles(i + 1), []
        while j < x.n and x.t[j] not in ("{", "where", ";"):
            if x.t[j] == "for":
                j += 1
                continue
            k = j
            while k < x.n and x.t[k] not in ("{", "where", "for", ";"):
                k = x.angles(k) if x.t[k] == "<" else x.after(k)
            if k == j + 1 and x.is_id(j):
                names.append(x.t[j])
            j = k
        return names[0] if names else None

    def at(self, i: int) -> None:
        x, t = self.x, self.x.t[i]
        scope = self.scope(("impl", "trait", "mod"))
        word = {"fn": "fn", "struct": "struct", "enum": "enum", "trait": "trait", "mod": "mod"}.get(t)
        if word and x.is_id(i + 1):
            end, brace = self.body(i + 2)
            if brace is not None:
                self.pending[brace] = ("callable" if t == "fn" else t, x.t[i + 1])
            # a signature without body is no item of its own
            if not self.local() and (t != "fn" or brace is not None):
                self.symbol(i + 1, word, end, "pub" if self._public(i) else "private", scope)
        elif t == "impl" and x.tok(i - 1) in ("", "}", ";", "{", "]", "unsafe", "default"):
            _, brace = self.body(i + 1)
            if brace is not None:
                self.pending[brace] = ("impl", self._impl_name(i))
        elif t == "type" and x.is_id(i + 1) and not self.local():
            end, _ = self.body(i + 2)
            inner = x.t[i + 2 : end]
            if "=" in inner:
                self.symbol(i + 1, "type", end, "pub" if self._public(i) else "private", scope)
        elif t in ("const", "static") and not self.local():
            j = i + 1 + (x.tok(i + 1) == "mut")
            if x.is_id(j) and x.tok(j + 1) == ":":
                end = j
                while end < x.n - 1 and x.t[end] != ";":
                    end = x.after(end)
                self.symbol(j, "const", end, "pub" if self._public(i) else "private", scope)
        elif t == "use":
            j, path = i + 1, ""
            while j < x.n and (x.is_id(j) or x.t[j] in ("::", "crate", "self", "super", "Self")):
                path += x.t[j]
                j += 1
            if "::" in path:
                self.imp(path.removesuffix("::"))
        elif x.is_id(i):
            n = x.tok(i + 1)
            if n == "!" and x.tok(i + 2) in _CLOSE:
                self.pending[i + 2] = ("macro", None)
            elif n == "(" and x.tok(i - 1) != "fn" and not any(f[1] == "macro" for f in self.frames) and not self._pattern(i):
                self.ref(i, x.tok(i - 1) in (".", "::"))

    def _pattern(self, i: int) -> bool:
        x, k = self.x, self.x.after(i + 1)
        if x.tok(k) in ("=>", "if") or (x.tok(k) == "=" and any(x.tok(j) == "let" for j in range(max(0, i - 6), i))):
            return True
        return self.frames and self.frames[-1][1] == "enum"


class Go(Scan):
    def at(self, i: int) -> None:
        x, t = self.x, self.x.t[i]
        if t == "func":
            j, scope = i + 1, None
            if not self.frames and x.tok(j) == "(":
                inner = [k for k in range(j + 1, x.match.get(j, j)) if x.is_id(k)]
                scope = x.t[inner[1] if len(inner) > 1 else inner[0]] if inner else None
                j = x.after(j)
            name = j if x.is_id(j) else None
            end, brace = self._body(j)
            if brace is not None:
                self.pending[brace] = ("callable", None)
            if name is not None and not self.local():
                self.symbol(name, "fn", end, self._vis(name), scope)
        elif t in ("type", "const", "var") and not self.local():
            specs = [i + 1]
            if x.tok(i + 1) == "(":
                specs = [j + 1 for j in range(i + 1, x.match.get(i + 1, i + 1)) if x.t[j] == "(" and j == i + 1 or x.k[j] == NEWLINE or x.t[j] == ";"]
                specs = [s for s in specs if sum(1 for f in self.frames) == 0 and not self._nested(i + 1, s)]
            end_all = x.match.get(i + 1) if x.tok(i + 1) == "(" else None
            for s in specs:
                if not x.is_id(s):
                    continue
                end = end_all if end_all is not None else self._stmt_end(s)
                if t == "type":
                    j = x.angles(s + 1)
                    j = x.after(j) if x.tok(j) == "[" and x.tok(x.after(j)) in ("struct", "interface") else j
                    if x.tok(j) in ("struct", "interface"):
                        self.symbol(s, "struct" if x.t[j] == "struct" else "interface", end, self._vis(s), None)
                else:
                    k = s
                    while x.is_id(k):
                        self.symbol(k, "const", end, self._vis(k), None)
                        if x.tok(k + 1) != ",":
                            break
                        k += 2
        elif t == "import":
            if x.tok(i + 1) == "(":
                for j in range(i + 2, x.match.get(i + 1, i + 1)):
                    if x.k[j] == STR:
                        self.imp(x.t[j].strip('"`'))
            else:
                for j in (i + 1, i + 2):
                    if j < x.n and x.k[j] == STR:
                        self.imp(x.t[j].strip('"`'))
                        break
        elif x.is_id(i) and x.tok(i + 1) == "(" and x.tok(i - 1) != "func" and not (x.tok(i - 1) == ")" and self._method_name(i)) and not any(f[1] == "interface" for f in self.frames):
            self.ref(i, x.tok(i - 1) == ".")
        elif t == "interface" and x.tok(i + 1) == "{":
            self.pending[i + 1] = ("interface", None)

    def _method_name(self, i: int) -> bool:
        o = next((a for a, b in self.x.match.items() if b == i - 1), None)
        return o is not None and self.x.tok(o - 1) == "func" and not self.frames

    def _nested(self, opening: int, s: int) -> bool:
        return any(o > opening and o < s < c for o, c in self.x.match.items() if o != opening and o < s)

    def _stmt_end(self, i: int) -> int:
        x = self.x
        while i < x.n and x.k[i] != NEWLINE and x.t[i] != ";":
            i = x.after(i)
        return i - 1

    def _body(self, i: int) -> tuple[int, int | None]:
        x = self.x
        while i < x.n and x.k[i] != NEWLINE:
            if x.t[i] in ("struct", "interface") and x.tok(i + 1) == "{":
                i = x.after(i + 1)
            elif x.t[i] == "{":
                return x.match.get(i, x.n - 1), i
            else:
                i = x.after(i)
        return i - 1, None

    def _vis(self, i: int) -> str:
        return "pub" if self.x.t[i][:1].isupper() else "private"


class Script(Scan):
    _MODS = ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "*", "abstract", "declare", "#")

    def __init__(self, text: str, language: str):
        super().__init__(text, language)
        self.ts = language == "typescript"

    def opened(self, i: int) -> str:
        x = self.x
        if x.t[i] != "{":
            return "block"
        p = x.prev(i)
        if p == "=>":
            return "callable"
        return "object" if p in ("=", "(", ",", ":", "return", "[", "default", "?", "&&", "||", "??") else "block"

    def _exported(self, i: int) -> bool:
        x, j = self.x, i - 1
        while j >= 0 and (x.t[j] in ("async", "default") or x.k[j] == NEWLINE):
            j -= 1
        return x.tok(j) == "export"

    def at(self, i: int) -> None:
        x, t = self.x, self.x.t[i]
        member = bool(self.frames) and self.frames[-1][1] in ("class", "object")
        named = x.is_id(i) or x.k[i] in self._words()
        vis = lambda: "pub" if self._exported(i) else "private"
        if t == "function":
            j = i + 1 + (x.tok(i + 1) == "*")
            end, brace = self._fn(x.angles(j + 1 if x.tok(j) != "(" else j))
            if brace is not None:
                self.pending[brace] = ("callable", None)
            start = i - (x.tok(i - 1) == "async")
            if x.is_id(j) and brace is not None and not self.local() and x.prev(start) in ("", "}", ";", "export", "default", "{", ")") + self._line_starts(start):
                self.symbol(j, "fn", end, vis(), None)
        elif t == "class" and x.tok(i - 1) not in (".",):
            end, brace = self.body(i + 1)
            name = x.t[i + 1] if x.is_id(i + 1) else None
            if brace is not None:
                self.pending[brace] = ("class", name)
            if name and not self.local() and x.prev(i) not in ("=", "(", ",", "abstract", "return"):
                self.symbol(i + 1, "class", end, vis(), None)
        elif t in ("const", "let", "var") and not member and not self.local() and x.tok(i + 1) != "enum" and not (self.frames and x.t[self._open()] in ("(", "[")):
            end = self.line_end(i + 1)
            j = i + 1
            while j <= end:
                if named or x.is_id(j) or x.k[j] in self._words():
                    self.symbol(j, "const", end, vis(), None)
                while j <= end and x.t[j] != ",":
                    j = x.angles(j) if x.t[j] == "<" and self.ts and x.prev(j) != "=" and x.angles(j) <= end else x.after(j)
                j = x.skip(j + 1)
        elif self.ts and t in ("interface", "type", "enum") and x.is_id(i + 1) and not member and not self.local() and x.tok(i - 1) != ".":
            if t == "type" and x.tok(x.angles(i + 2)) == "=":
                self.symbol(i + 1, "type", self.line_end(x.angles(i + 2) + 1), vis(), None)
            elif t != "type":
                end, brace = self.body(i + 2)
                if brace is not None:
                    self.pending[brace] = ("types", None)
                    start = i - (t == "enum" and x.tok(i - 1) == "const")
                    self.symbol(i + 1, t, end, "pub" if self._exported(start) else "private", None)
        elif t == "import" and x.tok(i + 1) not in ("(", "."):
            self._import(i)
        elif member and named and self._method(i):
            return
        elif x.is_id(i) and not any(f[1] == "types" for f in self.frames):
            if x.tok(i - 1) == "new":
                if x.tok(x.angles(i + 1)) != ".":
                    self.ref(i, False)
            elif x.tok(x.angles(i + 1) if self.ts and x.tok(i + 1) == "<" else i + 1) == "(" and x.prev(i) not in ("function", "class"):
                self.ref(i, x.tok(i - 1) in (".", "?."))
        elif named and x.tok(i - 1) in (".", "?.") and x.tok(i + 1) == "(":
            self.ref(i, True)

    def _words(self) -> set:
        s = scanner("typescript" if self.ts else "javascript")
        if not hasattr(self, "_w"):
            self._w = set(s.words.values())
        return self._w

    def _open(self) -> int:
        close = self.frames[-1][0]
        return next((o for o, c in self.x.match.items() if c == close), 0)

    def _line_starts(self, i: int) -> tuple[str, ...]:
        return (self.x.prev(i),) if i and self.x.k[i - 1] == NEWLINE else ()

    def _fn(self, i: int) -> tuple[int, int | None]:
        """Body of a callable whose parameter list opens at ``i``."""
        x = self.x
        if x.tok(i) != "(":
            return i, None
        j = x.skip(x.after(i))
        if x.tok(j) == ":":
            j += 1
            while j < x.n and x.t[j] not in (";", "}") and not (x.t[j] == "{" and x.prev(j) not in (":", "|", "&", "<", ",", "is")):
                j = x.angles(j) if x.t[j] == "<" else x.after(j)
        return (x.match.get(j, x.n - 1), j) if x.tok(j) == "{" else (j, None)

    def _method(self, i: int) -> bool:
        x, j = self.x, i - 1
        while j >= 0 and x.t[j] in self._MODS:
            j -= 1
        if x.tok(j) not in ("{", "}", ",", ";") and not (j >= 0 and x.k[j] == NEWLINE):
            return False
        open_at = x.angles(i + 1)
        end, brace = self._fn(open_at)
        if brace is None:
            return False
        self.pending[brace] = ("callable", None)
        if not self.local() and x.is_id(i) or x.t[i] == "constructor":
            self.symbol(i, "fn", end, "private", self.scope(("class",)))
        return True

    def _import(self, i: int) -> None:
        x, names, j = self.x, [], i + 1
        end = j
        while end < x.n and x.k[end] != STR:
            if x.t[end] == ";" or (x.k[end] == NEWLINE and x.tok(end - 1) not in (",", "{", "import") and x.tok(end + 1) not in ("from", "}", ",", "{")):
                return
            end += 1
        if end == x.n:
            return
        while j < end:
            if x.t[j] == "{":
                stop = x.match.get(j, end)
                j += 1
                while j < stop:
                    if x.tok(j) == "type" and x.tok(j + 1) not in (",", "as", "}"):
                        j += 1
                    if x.k[j] == NEWLINE or x.t[j] == ",":
                        j += 1
                        continue
                    if x.tok(j + 1) == "as":
                        j += 2
                    names.append(x.t[j])
                    j += 1
            elif x.t[j] == "*" and x.tok(j + 1) == "as":
                names.append(x.tok(j + 2))
                j += 3
                continue
            elif x.t[j] == "type" and x.tok(j + 1) not in ("from", ","):
                pass
            elif x.is_id(j) or x.t[j] not in ("from", ",", "}") and x.k[j] != NEWLINE:
                names.append(x.t[j])
            j += 1
        self.imp(x.t[end].strip("'\""), names)


class Swift(Scan):
    def at(self, i: int) -> None:
        x, t = self.x, self.x.t[i]
        if t == "func" or t in ("init", "deinit") and self.frames and self.frames[-1][1] == "type":
            end, brace = self._header(i + 1)
            if brace is not None:
                self.pending[brace] = ("callable", None)
            if t == "func" and x.is_id(i + 1) and not self.local():
                self.symbol(i + 1, "fn", end, self._vis(i), self.scope(("type",)))
        elif t in ("struct", "class", "enum", "actor", "protocol", "extension") and x.is_id(i + 1) and not (t == "class" and x.tok(i + 1) in ("func", "var", "let")):
            end, brace = self.body(i + 2)
            if brace is not None:
                self.pending[brace] = ("type", x.t[i + 1])
                if t != "extension" and not self.local():
                    # types are placed by their name alone and never count as public
                    kind = {"actor": "class", "protocol": "trait"}.get(t, t)
                    self.symbol(i + 1, kind, i + 1, "private", self.scope(("type",)))
        elif t == "typealias" and x.is_id(i + 1) and not self.local():
            self.symbol(i + 1, "type", self.line_end(i + 2), self._vis(i), self.scope(("type",)))
        elif t == "import":
            j = i + 1 + (x.tok(i + 1) in ("struct", "class", "enum", "protocol", "func", "var", "let", "typealias"))
            path = ""
            while x.is_id(j) or x.tok(j) == ".":
                path += x.t[j]
                j += 1
            self.imp(path)
        elif x.is_id(i) and x.tok(i + 1) == "(" and x.tok(i - 1) not in (".", "func", "case", "@", "#", "macro"):
            self.ref(i, False)

    def opened(self, i: int) -> str:
        return "callable" if self.x.t[i] == "{" and self.x.prev(i) in ("=", "(", ",", ")") else "block"

    def _header(self, i: int) -> tuple[int, int | None]:
        x = self.x
        while i < x.n:
            if x.t[i] == "{":
                return x.match.get(i, x.n - 1), i
            if x.t[i] in ("}", ";") or (x.k[i] == NEWLINE and x.tok(i + 1) not in ("{", "->", "where", "throws", "async")):
                return i - 1, None
            i = x.after(i)
        return x.n - 1, None

    def _vis(self, i: int) -> str:
        x, j = self.x, i - 1
        while j >= 0 and x.k[j] != NEWLINE and x.t[j] not in ("{", "}", ";"):
            j -= 1
        return "pub" if x.tok(j + 1) in ("public", "open") else "private"


class CSharp(Scan):
    #: behind the last type name that a creation has listed
    named = 0
    _TYPES = {"class": "class", "struct": "struct", "interface": "interface", "enum": "enum", "record": "class"}
    _MODS = ("public", "private", "protected", "internal", "static", "readonly", "sealed", "abstract", "virtual", "override", "new", "extern", "unsafe", "volatile", "async", "partial", "const", "required", "file", "ref")

    def _scope(self) -> str | None:
        return self.scope(("type", "interface")) or self.scope(("namespace",))

    def at(self, i: int) -> None:
        x, t = self.x, self.x.t[i]
        frame = self.frames[-1] if self.frames else (0, "file", None)
        outer = frame[1] in ("file", "namespace", "type", "interface")
        if t == "namespace":
            j, name = i + 1, ""
            while self._word(j) or x.tok(j) == ".":
                name += x.t[j]
                j += 1
            end, brace = (x.match.get(j, x.n - 1), j) if x.tok(j) == "{" else (j, None)
            if brace is not None:
                self.pending[brace] = ("namespace", name)
            if name:
                self.symbol(i + 1, "mod", end, "pub", None, name)
        elif t == "using" and frame[1] in ("file", "namespace") and x.tok(i + 1) != "(":
            j = i + 1 + (x.tok(i + 1) in ("static", "unsafe"))
            alias = x.t[j] if x.tok(j + 1) == "=" else None
            j += 2 * (alias is not None)
            path = ""
            while self._word(j) or x.tok(j) in (".", "::", "<", ">", ","):
                path += x.t[j]
                j += 1
            if x.tok(j) == ";":
                self.imp(path, alias=alias)
        elif t in self._TYPES and outer and x.is_id(i + 1 + (t == "record" and x.tok(i + 1) in ("class", "struct"))) and x.tok(i - 1) not in (":", ",", "record"):
            name = i + 1 + (t == "record" and x.tok(i + 1) in ("class", "struct"))
            end, brace = self.body(name + 1)
            if brace is not None:
                self.pending[brace] = ("interface" if t == "interface" else "enum" if t == "enum" else "type", x.t[name])
            self.symbol(name, self._TYPES[t], end, self._vis(i), self._scope())
        elif self._word(i) and frame[1] in ("type", "interface") and self._member(i):
            return
        elif t == "new" and self._created(i + 1):
            return
        elif i < self.named:
            return
        elif x.is_id(i) and frame[1] not in ("file", "namespace", "type", "interface", "enum"):
            if x.tok(i + 1) == "(":
                self.ref(i, x.tok(i - 1) in (".", "?."), self._scope())
        elif x.is_id(i) and x.tok(i + 1) == "(" and x.tok(i - 1) in (".", "?.", "=", "=>", "(", ",", "return"):
            self.ref(i, x.tok(i - 1) in (".", "?."), self._scope())

    def _created(self, i: int) -> bool:
        """A creation of the type named at ``i``: listed by its name, without
        arguments, or by all of a qualified name."""
        x, j, parts, simple = self.x, i, [], True
        while x.tok(j)[:1].isalpha() or x.tok(j)[:1] in ("_", "@"):
            parts.append(x.t[j])
            j = x.angles(j + 1)
            if x.tok(j) not in (".", "::"):
                break
            simple = False
            j += 1
        if not parts or x.tok(j) not in ("(", "{"):
            return False
        self.ref(i, False, self._scope(), parts[0] if simple else x.text[x.at[i] : x.at[j - 1] + len(x.t[j - 1])])
        self.named = j
        return True

    def _word(self, i: int) -> bool:
        x = self.x
        return x.is_id(i) or 0 <= i < x.n and x.t[i].isidentifier() and x.t[i] in _CONTEXTUAL

    def _head(self, i: int) -> int:
        """First token of the member that ``i`` stands in."""
        x, j = self.x, i - 1
        back = {c: o for o, c in x.match.items()}
        while j >= 0 and x.t[j] not in ("{", "}", ";"):
            if x.t[j] == ")" and j in back:
                j = back[j]
            elif x.t[j] == "]" and j in back:
                if x.tok(back[j] - 1) in ("{", "}", ";", "]", ""):
                    break
                j = back[j]
            j -= 1
        return j + 1

    def _member(self, i: int) -> bool:
        x = self.x
        after = x.angles(i + 1)
        n = x.tok(after)
        if n not in ("(", "{", "=>") or (n != "(" and after != i + 1):
            return False
        head = self._head(i)
        lead = x.t[head:i]
        if "=" in lead or "=>" in lead or "where" in lead or ":" in lead or any(w in lead for w in ("event", "delegate", "operator", "class", "struct", "interface", "enum", "record", "return")):
            return False
        rest = [w for w in lead if w not in self._MODS]
        owner = self.scope(("type", "interface"))
        if n == "(" and not rest and x.t[i] != owner:
            return False
        if n != "(" and not rest:
            return False
        if n == "(":
            close = x.after(after)
            end, brace = self.body(close)
        else:
            end, brace = (x.match.get(after, x.n - 1), after) if n == "{" else self.body(after + 1)
            if n == "{" and x.tok(end + 1) == "=":
                end = self.body(end + 1)[0]
        if brace is not None:
            self.pending[brace] = ("callable", None)
        interface = self.frames[-1][1] == "interface"
        vis = self._vis(i, lead)
        if interface and not any(m in lead for m in ("public", "private", "protected", "internal")):
            vis = "pub"
        self.symbol(i, "fn", end, vis, self._scope())
        return True

    def _vis(self, i: int, lead: list[str] | None = None) -> str:
        for w in lead if lead is not None else self.x.t[self._head(i) : i]:
            if w == "public":
                return "pub"
            if w in ("private", "protected", "internal"):
                return "private"
        return "private"


_CONTEXTUAL = frozenset("add alias async by descending dynamic equals file from get global group init into join let managed nameof on orderby partial record remove required scoped select set unmanaged value var when where with yield".split())

_SCANS = {"python": Python, "rust": Rust, "go": Go, "typescript": Script, "javascript": Script, "swift": Swift, "csharp": CSharp}


def parse(text: str, language: str) -> Parsed:
    """What one text declares, imports and uses; nothing for other languages."""
    return _SCANS[language](text, language).run() if language in _SCANS else Parsed()
