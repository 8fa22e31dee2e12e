"""Bodies of Rust and C# functions as steps, from positioned tokens."""

from __future__ import annotations

import sys

from codeloom.extract.scan import CSharp, Rust, Tokens
from codeloom.flow.graph import Arm, Builder, Call, FlowError, NoBody, Step, label, left_label, one_line

_CLOSE = {"(": ")", "[": "]", "{": "}"}


class Body:
    """Shared token work of a body parser."""

    def __init__(self, x: Tokens):
        self.x = x

    def text(self, i: int, j: int) -> str:
        """Source of tokens i..j-1."""
        x = self.x
        return x.text[x.at[i] : x.at[j - 1] + len(x.t[j - 1])] if j > i else ""

    def line(self, i: int) -> int:
        return self.x.place(i)[0]

    def find(self, i: int, end: int, *stops: str) -> int:
        """First of ``stops`` outside brackets, or ``end``."""
        x = self.x
        while i < end and x.t[i] not in stops:
            i = x.after(i)
        return min(i, end)

    def parts(self, i: int, end: int) -> list[str]:
        """Texts between commas outside brackets and angle lists."""
        x, out, start, depth = self.x, [], i, 0
        while i < end:
            depth += (x.t[i] == "<") - (x.t[i] == ">")
            if x.t[i] == "," and depth <= 0:
                out.append(label(self.text(start, i)))
                start = i + 1
            i = x.after(i)
        if start < end:
            out.append(label(self.text(start, end)))
        return [p for p in out if p]

    def calls(self, i: int, end: int, skip: tuple[int, int] | None = None) -> list[Call]:
        """Calls of tokens i..end-1 in order of evaluation."""
        out: list[Call] = []
        self._calls(i, end, out, skip)
        return out

    def _calls(self, i: int, end: int, out: list[Call], skip: tuple[int, int] | None) -> None:
        x, start = self.x, None
        while i < end:
            if skip and skip[0] <= i < skip[1]:
                i, start = skip[1], None
                continue
            past = self.closure(i, end)
            if past:
                i, start = past, None
                continue
            t = x.t[i]
            if t in _CLOSE:
                close = min(x.match.get(i, end), end)
                made = t == "(" and start is not None and self.callee_end(i)
                chained = start is not None and (t != "{" or self.literal(i))
                self._calls(i + 1, close, out, skip)
                if made:
                    self.made(start, i, close, out)
                elif not chained:
                    start = i if t == "(" or t == "[" else None
                i = close + 1
                continue
            special = self.special(i, end, start, out, skip)
            if special:
                i, start = special
                continue
            if self.continues(i):
                pass
            elif self.begins(i):
                start = i if not self.joined(i) else start
            else:
                start = None
            i += 1

    def joined(self, i: int) -> bool:
        return self.x.tok(i - 1) in (".", "::", "?.")


class RustBody(Body):
    _BLOCKS = ("if", "match", "for", "while", "loop", "{", "unsafe", "async")
    _ITEMS = ("fn", "struct", "enum", "impl", "mod", "use", "trait", "type", "extern", "macro_rules", "union")

    def callee_end(self, i: int) -> bool:
        x = self.x
        return x.is_id(i - 1) or x.tok(i - 1) in (")", "]", ">", "self", "Self", "crate", "super", "await", "?")

    def literal(self, i: int) -> bool:
        return False

    def continues(self, i: int) -> bool:
        x, t = self.x, self.x.t[i]
        return t in (".", "::", "?") or (t == "await" and x.tok(i - 1) == ".") or (t in ("<", ">") and False)

    def begins(self, i: int) -> bool:
        return self.x.is_id(i) or self.x.t[i] in ("self", "Self", "crate", "super") or self.x.k[i] in "0\"'"

    def closure(self, i: int, end: int) -> int | None:
        x = self.x
        if x.t[i] in ("|", "||") and (i == 0 or x.tok(i - 1) in ("(", ",", "=", "move", "=>", "{", "return", ":", "async", ";", "&", "[")):
            j = i + 1 if x.t[i] == "||" else self.find(i + 1, end, "|") + 1
            if x.tok(j) == "->":
                j = self.find(j, end, "{")
            if x.tok(j) == "{" and x.after(j) <= end and x.tok(x.after(j)) not in (".", "?"):
                return x.after(j)
            return self.find(j, end, ",", ";")
        if x.t[i] == "fn" and x.is_id(i + 1):
            return min(x.after(self.find(i, end, "{", ";")), end)
        return None

    def special(self, i: int, end: int, start: int | None, out: list[Call], skip) -> tuple[int, int | None] | None:
        x = self.x
        if x.t[i] == "::" and x.tok(i + 1) == "<":  # turbofish
            return x.angles(i + 1), start
        if x.t[i] == "!" and x.is_id(i - 1) and x.tok(i + 1) in _CLOSE and start is not None:
            close = min(x.match.get(i + 1, end), end)
            out.append(Call(f"{label(self.text(start, i))}!", self.line(start), self.fallible(close)))
            return close + 1, start
        return None

    def made(self, start: int, opening: int, close: int, out: list[Call]) -> None:
        out.append(Call(f"{label(self.text(start, opening))}(…)", self.line(start), self.fallible(close)))

    def fallible(self, close: int) -> bool:
        x, j = self.x, close + 1
        while x.tok(j) == ")" and self._wraps(j) or (x.tok(j) == "." and x.tok(j + 1) == "await"):
            j += 1 if x.tok(j) == ")" else 2
        return x.tok(j) == "?"

    def _wraps(self, close: int) -> bool:
        """The bracket that closes here only groups (no call, no tuple)."""
        x = self.x
        o = next((a for a, b in x.match.items() if b == close), None)
        return o is not None and x.tok(o) == "(" and not self.callee_end(o) and self.find(o + 1, close, ",") == close

    # -- statements ----------------------------------------------------------
    def block(self, opening: int, tail: bool) -> list[Step]:
        return self.steps(opening + 1, self.x.match.get(opening, self.x.n), tail)

    def steps(self, i: int, end: int, tail: bool) -> list[Step]:
        x, out = self.x, []
        while i < end:
            if x.t[i] == ";":
                i += 1
            elif x.t[i] == "#" and x.tok(i + 1) in ("[", "!"):
                i = x.after(i + 1 + (x.t[i + 1] == "!"))
            else:
                step, i = self.statement(i, end, tail)
                out += step
        return out

    def statement(self, i: int, end: int, tail: bool) -> tuple[list[Step], int]:
        x, t = self.x, self.x.t[i]
        if t == "let":
            return self.let(i, end)
        j = i
        if t == "pub":
            j = x.after(i + 1) if x.tok(i + 1) == "(" else i + 1
        k = j
        while x.tok(k) in ("const", "async", "unsafe", "extern") and x.tok(k + 1) not in ("{", "move", "|", "||"):
            k += 1 + (k + 1 < x.n and x.k[k + 1] == '"')
        if x.tok(j) in ("const", "static") and x.tok(k) != "fn" and x.is_id(j + 1):
            stop = self.find(j, end, ";")
            at = self.find(j, stop, "=")
            return [Step("calls", calls=self.calls(at, stop))], stop + 1
        if x.tok(k) in self._ITEMS and (x.tok(k) != "union" or x.is_id(k + 1)):
            stop = self.find(k, end, "{", ";")
            return [], (x.after(stop) if x.tok(stop) == "{" else stop + 1)
        if t in self._BLOCKS or (x.k[i] == "L" and x.tok(i + 1) == ":"):
            step, after = self.control(i, end, False)
            if step is not None and x.tok(after) not in (".", "?"):
                last = tail and after >= end
                return (self.control(i, end, True)[0] if last else step), after
        stop = self.find(i, end, ";")
        return self.expression(i, stop, tail and stop >= end), stop + 1

    def expression(self, i: int, end: int, tail: bool) -> list[Step]:
        """An expression on its own, by what it begins with."""
        x = self.x
        if i >= end:
            return []
        t = x.t[i]
        if t in ("return", "break", "continue"):
            name = None
            if t != "return" and x.tok(i + 1)[:1] == "'" and x.k[i + 1] == "L":
                name = x.t[i + 1]
            return [Step("jump", self.line(i), label(self.text(i, end)), self.calls(i + 1, end) if t != "continue" else [], node=t, name=name)]
        if t in self._BLOCKS or x.k[i] == "L":
            step, after = self.control(i, end, tail)
            if step is not None and after >= end:
                return step
        if tail:
            return [Step("jump", self.line(i), label(self.text(i, end)), self.calls(i, end), node="return")]
        return [Step("calls", calls=self.calls(i, end))]

    def condition(self, i: int, end: int) -> list[Call]:
        """Calls of a condition, without the patterns of its ``let`` parts."""
        out, start = [], i
        while (at := self.find(start, end, "let")) < end:
            out += self.calls(start, at)
            start = self.find(at, end, "=") + 1
        return out + self.calls(start, end)

    def let(self, i: int, end: int) -> tuple[list[Step], int]:
        x = self.x
        stop = self.find(i, end, ";")
        at = self.find(i, stop, "=")
        colon = self.find(i + 1, at, ":")
        other = self.find(at, stop, "else") if at < stop else stop
        head = x.tok(at + 1)
        if at < stop and head in ("if", "match", "for", "while", "loop"):
            step, after = self.control(at + 1, stop, False)
            if step is not None and after >= stop:
                return step, stop + 1
        if other < stop and x.tok(other + 1) == "{" and head != "if":
            text = f"let {label(self.text(i + 1, colon))} = {label(self.text(at + 1, other))}"
            arm = Arm("else", self.block(other + 1, False), diverges=True)
            return [Step("branch", self.line(i), text, self.calls(at + 1, other), arms=[arm], falls="bound")], stop + 1
        return [Step("calls", calls=self.calls(at, stop))], stop + 1

    def control(self, i: int, end: int, tail: bool) -> tuple[list[Step] | None, int]:
        """A block-like expression at ``i`` and the index behind it."""
        x, name, at = self.x, None, i
        if x.k[i] == "L" and x.tok(i + 1) == ":":
            name, i = x.t[i], i + 2
        t = x.tok(i)
        if t in ("unsafe", "async"):
            j = i + 1 + (x.tok(i + 1) == "move")
            return ([Step("block", body=self.block(j, tail))], x.after(j)) if x.tok(j) == "{" else (None, i)
        if t == "{":
            return [Step("block", body=self.block(i, tail))], x.after(i)
        if t == "if":
            return self.branch(i, end, tail)
        if t == "loop" and x.tok(i + 1) == "{":
            return [Step("loop", self.line(at), "loop", body=self.block(i + 1, False), name=name, endless=True)], x.after(i + 1)
        brace = self.find(i + 1, end, "{")
        if brace >= end:
            return None, i
        if t == "while":
            return [Step("loop", self.line(at), f"while {label(self.text(i + 1, brace))}", self.condition(i + 1, brace), self.block(brace, False), name=name)], x.after(brace)
        if t == "for":
            mid = self.find(i + 1, brace, "in")
            text = f"for {label(self.text(i + 1, mid))} in {label(self.text(mid + 1, brace))}"
            return [Step("loop", self.line(at), text, self.calls(mid + 1, brace), self.block(brace, False), name=name)], x.after(brace)
        if t == "match":
            close = x.match.get(brace, end)
            step = Step("match", self.line(i), f"match {label(self.text(i + 1, brace))}", self.calls(i + 1, brace))
            j = brace + 1
            while j < close:
                if x.t[j] == "#" and x.tok(j + 1) == "[":
                    j = x.after(j + 1)
                    continue
                arrow = self.find(j, close, "=>")
                if arrow >= close:
                    break
                guard = self.find(j, arrow, "if")
                body, after = None, arrow + 1
                if x.tok(after) in self._BLOCKS or x.k[after] == "L":
                    body, after = self.control(after, close, tail)
                    if body is not None and x.tok(after) not in (",", "}") and not (x.tok(arrow + 1) == "{" and x.tok(after) not in (".", "?")):
                        body = None
                if body is None:
                    after = self.find(arrow + 1, close, ",")
                    body = self.expression(arrow + 1, after, tail)
                step.arms.append(Arm(label(self.text(j, arrow)), body, self.condition(guard, arrow) if guard < arrow else []))
                j = after + (x.tok(after) == ",")
            return [step], close + 1
        return None, i

    def branch(self, i: int, end: int, tail: bool) -> tuple[list[Step] | None, int]:
        x = self.x
        brace = self.find(i + 1, end, "{")
        if brace >= end:
            return None, i
        step = Step("branch", self.line(i), label(self.text(i + 1, brace)), self.condition(i + 1, brace), arms=[Arm("true", self.block(brace, tail))])
        after = x.after(brace)
        if x.tok(after) == "else" and after < end:
            if x.tok(after + 1) == "if":
                inner, after = self.branch(after + 1, end, tail)
                step.arms.append(Arm("false", inner or []))
            else:
                step.arms.append(Arm("false", self.block(after + 1, tail)))
                after = x.after(after + 1)
        else:
            step.falls = "false"
        return [step], after


class CSharpBody(Body):
    def find(self, i: int, end: int, *stops: str) -> int:
        """As above; commas in type argument lists are no stops."""
        x = self.x
        while i < end and x.t[i] not in stops:
            if x.t[i] == "<" and self.word(i - 1) and "," in stops:
                j = x.angles(i)
                if x.tok(j - 1) == ">" and x.tok(j) in ("(", "{", ")", ".", ",", ";", "[", ">", "?") and not any(w in ("&&", "||", ";", "==") for w in x.t[i:j]):
                    i = j
                    continue
            i = x.after(i)
        return min(i, end)

    def callee_end(self, i: int) -> bool:
        x = self.x
        return x.is_id(i - 1) or x.tok(i - 1) in (")", "]", ">", "this", "base", "!") or self.word(i - 1)

    def word(self, i: int) -> bool:
        x = self.x
        return x.is_id(i) or x.tok(i) in ("nameof", "value", "get", "set", "add", "remove", "select", "where", "from", "on", "by", "into", "var", "record", "init", "async", "when", "and", "or", "not", "with", "file", "required", "global", "group", "join", "let", "orderby", "equals", "dynamic", "partial", "notnull", "alias", "yield", "scoped", "managed")

    def literal(self, i: int) -> bool:
        return False

    def continues(self, i: int) -> bool:
        x, t = self.x, self.x.t[i]
        return t in (".", "?.", "::") or (t == "!" and (self.word(i - 1) or x.tok(i - 1) in (")", "]"))) or (t == "?" and x.tok(i + 1) == "[")

    def begins(self, i: int) -> bool:
        x = self.x
        return self.word(i) or x.t[i] in ("this", "base", "string", "int", "long", "double", "bool", "object", "decimal", "char", "byte", "float") or x.k[i] in "0\"'"

    def closure(self, i: int, end: int) -> int | None:
        x, arrow = self.x, None
        if x.t[i] == "delegate" and x.tok(i + 1) in ("(", "{"):
            return min(x.after(self.find(i, end, "{")), end)
        if x.t[i] == "(" and x.tok(x.after(i)) == "=>" and not (self.word(i - 1) or x.tok(i - 1) in (")", ">")):
            arrow = x.after(i)
        elif self.word(i) and x.tok(i + 1) == "=>":
            arrow = i + 1
        if arrow is None or arrow >= end:
            return None
        if x.tok(arrow + 1) == "{":
            return min(x.after(arrow + 1), end)
        return self.find(arrow + 1, end, ",", ";")

    def special(self, i: int, end: int, start: int | None, out: list[Call], skip) -> tuple[int, int | None] | None:
        x = self.x
        if x.t[i] == "new" and (self.word(i + 1) or x.tok(i + 1) in ("string", "int", "object")):
            j = i + 1
            while j < end and (self.word(j) or x.t[j] in (".", "::", "string", "int", "object", "?")):
                j += 1
                if x.tok(j) == "<":
                    j = x.angles(j)
            if x.tok(j) in ("(", "{") and j < end:
                close = j
                if x.t[j] == "(":
                    close = min(x.match.get(j, end), end)
                    self._calls(j + 1, close, out, skip)
                    if x.tok(close + 1) == "{":
                        j = close + 1
                if x.tok(j) == "{":
                    close = min(x.match.get(j, end), end)
                    self._calls(j + 1, close, out, skip)
                stop = next(k for k in range(i + 1, end + 1) if x.tok(k) in ("(", "{"))
                out.append(Call(f"new {label(self.text(i + 1, stop))}(…)", self.line(i)))
                return close + 1, i
            return j, None
        if x.t[i] == "<" and start is not None and self.word(i - 1):
            j = x.angles(i)
            if x.tok(j) == "(" and x.tok(j - 1) == ">" and all(w not in (";", "&&", "||", "(") for w in x.t[i:j]):
                return j, start
        return None

    def made(self, start: int, opening: int, close: int, out: list[Call]) -> None:
        text = self.text(start, opening)
        chained = any(w in (".", "?.") for w in self.x.t[start:opening])
        out.append(Call(f"{left_label(text) if chained else label(text)}(…)", self.line(start)))

    # -- statements ----------------------------------------------------------
    def block(self, opening: int) -> list[Step]:
        return self.steps(opening + 1, self.x.match.get(opening, self.x.n))

    def steps(self, i: int, end: int) -> list[Step]:
        out: list[Step] = []
        while i < end:
            made, i = self.statement(i, end)
            out += made
        return out

    def statement(self, i: int, end: int) -> tuple[list[Step], int]:
        x, t, line = self.x, self.x.t[i], self.line(i)
        if t == ";":
            return [], i + 1
        if t == "{":
            return [Step("block", body=self.block(i))], x.after(i)
        if t == "[":  # attributes of a local function
            return self.statement(x.after(i), end) if x.after(i) < end else ([], end)
        if t == "if" and x.tok(i + 1) == "(":
            a, b = i + 2, x.match.get(i + 1, end)
            step = Step("branch", line, label(self.text(a, b)), self.calls(a, b))
            body, after = self.statement(b + 1, end)
            step.arms.append(Arm("true", body))
            if x.tok(after) == "else" and after < end:
                other, after = self.statement(after + 1, end)
                step.arms.append(Arm("false", other))
            else:
                step.falls = "false"
            return [step], after
        if t == "switch" and x.tok(i + 1) == "(":
            return self.switch(i, end)
        j = i + (t == "await")
        head = x.tok(j)
        if head in ("while", "for", "foreach") and x.tok(j + 1) == "(":
            a, b = j + 2, x.match.get(j + 1, end)
            body, after = self.statement(b + 1, end)
            if head == "while":
                return [Step("loop", line, f"while ({label(self.text(a, b))})", self.calls(a, b), body)], after
            if head == "foreach":
                mid = self.find(a, b, "in")
                left = f"{label(self.text(a, mid - 1))} {label(self.text(mid - 1, mid))}" if mid - 1 > a else label(self.text(a, mid))
                return [Step("loop", line, f"foreach ({left} in {label(self.text(mid + 1, b))})", self.calls(mid + 1, b), body)], after
            p = self.find(a, b, ";")
            q = self.find(p + 1, b, ";")
            text = f"for ({label(self.text(a, p))}; {label(self.text(p + 1, q))}; {', '.join(self.parts(q + 1, b))})"
            return [Step("loop", line, text, self.calls(a, p) + self.calls(p + 1, q), body)], after
        if t == "do":
            body, after = self.statement(i + 1, end)
            a = after + 2
            b = x.match.get(after + 1, end)
            return [Step("loop", line, f"do while ({label(self.text(a, b))})", self.calls(a, b), body)], min(b + 2, end)
        if t == "try" and x.tok(i + 1) == "{":
            return self.attempt(i, end)
        if head in ("using", "lock", "fixed", "checked", "unchecked", "unsafe") and x.tok(j + 1) in ("(", "{"):
            calls, k = [], j + 1
            if x.t[k] == "(":
                calls, k = self.calls(k + 1, x.match.get(k, end)), x.after(k)
            body, after = self.statement(k, end)
            return [Step("block", line, calls=calls, body=body)], after
        if self.word(i) and x.tok(i + 1) == ":" and x.tok(i + 2) != ":":
            return self.statement(i + 2, end)
        local = self.local_function(i, end)
        if local is not None:
            return [], local
        stop = self.find(i, end, ";")
        text = label(self.text(i, min(stop + 1, end)))
        if t == "return":
            return self.valued(i + 1, stop) + [Step("jump", line, text, node="return")], stop + 1
        if t == "throw":
            return [Step("jump", line, text, self.calls(i, stop), node="throw")], stop + 1
        if t == "yield" and x.tok(i + 1) in ("return", "break"):
            return [Step("jump", line, text, self.calls(i + 2, stop), node="yield" if x.t[i + 1] == "return" else "return")], stop + 1
        if t in ("break", "continue", "goto"):
            return [Step("jump", line, text, node=t)], stop + 1
        start = i
        if t == "using" or (t == "await" and head == "using"):
            start = j + 1
        return self.valued(start, stop), stop + 1

    def local_function(self, i: int, end: int) -> int | None:
        """Index behind a local function that begins at ``i``."""
        x, j = self.x, i
        while x.tok(j) in ("static", "async", "unsafe", "extern"):
            j += 1
        k = j
        while k < end and x.t[k] not in ("(", ";", "=", "{", "=>"):
            k = x.angles(k) if x.t[k] == "<" else k + 1
        if x.tok(k) == "(" and x.tok(j) == "(":
            k = self.find(x.after(k), end, "(", ";", "=", "{")
        if x.tok(k) != "(" or k - j < 2 or x.tok(j) in ("new", "await", "return", "throw") or any(w in (".", "?.") for w in x.t[k - 2 : k]):
            return None
        after = x.after(k)
        if x.tok(after) == "{":
            return x.after(after)
        if x.tok(after) == "=>":
            return self.find(after, end, ";") + 1
        return None

    def valued(self, i: int, end: int) -> list[Step]:
        """A statement without control flow of its own, save a switch that chooses its value."""
        x, at = self.x, i
        k = i
        while k < end:
            if x.t[k] in ("=", "??="):
                at = k + 1
            k = x.after(k)
        word = self.find(at, end, "switch")
        if word < end and word > at and x.tok(word + 1) == "{" and x.after(word + 1) >= end:
            made = Step("calls", calls=self.calls(i, end, (at, end)))
            return [made, self.choice(at, word, end)]
        return [Step("calls", calls=self.calls(i, end))]

    def choice(self, a: int, word: int, end: int) -> Step:
        """``value switch { arms }``."""
        x = self.x
        step = Step("match", self.line(a), f"switch {label(self.text(a, word))}", self.calls(a, word), ordered=True)
        i, close = word + 2, x.match.get(word + 1, end)
        while i < close:
            arrow = self.find(i, close, "=>")
            if arrow >= close:
                break
            stop = self.find(arrow + 1, close, ",")
            guard = self.find(i, arrow, "when")
            text = label(self.text(i, guard)) + (f" {label(self.text(guard, arrow))}" if guard < arrow else "")
            step.arms.append(Arm(text, self.valued(arrow + 1, stop)))
            i = stop + 1
        return step

    def switch(self, i: int, end: int) -> tuple[list[Step], int]:
        x = self.x
        a, b = i + 2, x.match.get(i + 1, end)
        step = Step("match", self.line(i), f"switch {label(self.text(a, b))}", self.calls(a, b), breakable=True, ordered=True)
        brace = b + 1
        j, close = brace + 1, x.match.get(brace, end)
        labels: list[str] = []
        default = False
        while j < close:
            while j < close and (x.t[j] == "case" or (x.t[j] == "default" and x.tok(j + 1) == ":")):
                colon = self.colon(j + 1, close)
                guard = self.find(j, colon, "when")
                if x.t[j] == "default":
                    default = True
                    labels.append("default")
                else:
                    labels.append(label(self.text(j + 1, guard)) + (f" {label(self.text(guard, colon))}" if guard < colon else ""))
                j = colon + 1
            stop = j
            while stop < close and not (x.t[stop] == "case" and x.tok(stop - 1) != "goto" or (x.t[stop] == "default" and x.tok(stop + 1) == ":")):
                stop = x.after(stop)
            if stop > j:
                step.arms.append(Arm(labels[0] if labels else "", self.steps(j, stop), labels=labels))
                labels = []
            j = max(stop, j + (stop == j and x.tok(j) not in ("case", "default")))
        if labels:
            step.arms.append(Arm(labels[0], labels=labels))
        if not default:
            step.falls = "no match"
        return [step], close + 1

    def colon(self, i: int, end: int) -> int:
        """The colon that ends a case label (not one of a conditional)."""
        x, asked = self.x, 0
        while i < end:
            if x.t[i] == "?" and x.tok(i + 1) not in (",", ")", "["):
                asked += 1
            elif x.t[i] == ":":
                if not asked:
                    return i
                asked -= 1
            i = x.after(i)
        return end

    def attempt(self, i: int, end: int) -> tuple[list[Step], int]:
        x = self.x
        step, j = Step("try", self.line(i), body=self.block(i + 1)), x.after(i + 1)
        while x.tok(j) == "catch" and j < end:
            text, before, j = "catch", [], j + 1
            if x.tok(j) == "(":
                text, j = f"catch {label(self.text(j, x.after(j)))}", x.after(j)
            if x.tok(j) == "when":
                text, before, j = f"{text} {label(self.text(j, x.after(j + 1)))}", self.calls(j + 1, x.after(j + 1)), x.after(j + 1)
            step.arms.append(Arm(text, self.block(j), before))
            j = x.after(j)
        if x.tok(j) == "finally" and j < end:
            step.final, j = self.block(j + 1), x.after(j + 1)
        return [step], j


# -- finding the function ------------------------------------------------------
class _RustFinder(Rust):
    def run(self):
        self.found: list[tuple[int, str | None, int, int, int]] = []
        return super().run()

    def at(self, i: int) -> None:
        x = self.x
        if x.t[i] == "fn" and x.is_id(i + 1):
            end, brace = self.body(i + 2)
            if brace is not None:
                j = i - 1
                while j >= 0 and (x.t[j] in self._MODS or x.k[j] == '"'):
                    j -= 1
                if x.tok(j) == ")":
                    o = next((a for a, b in x.match.items() if b == j), j)
                    j = o - 1 if x.tok(o - 1) == "pub" else j
                first = j if x.tok(j) == "pub" else j + 1
                self.found.append((i + 1, self.scope(("impl", "trait", "mod")), first, brace, end))
        super().at(i)


class _CSharpFinder(CSharp):
    def run(self):
        self.found: list[tuple[int, str | None, int, int, int]] = []
        return super().run()

    def _member(self, i: int) -> bool:
        x, scope = self.x, self._scope()
        if not super()._member(i):
            return False
        first = self._head(i)
        while x.tok(first - 1) == "]":
            o = next((a for a, b in x.match.items() if b == first - 1), None)
            if o is None or x.tok(o - 1) not in ("{", "}", ";", "]"):
                break
            first = o
        after = x.angles(i + 1)
        at = x.after(after) if x.tok(after) == "(" else after
        at = next((k for k in range(at, x.n) if x.t[k] in ("{", "=>", ";")), x.n - 1)
        end = x.match.get(at, at) if x.t[at] == "{" else self.body(at)[0] if x.t[at] == "=>" else at
        self.found.append((i, scope, first, at, end))
        return True


def locate(found: list, x: Tokens, name: str, scope: str | None, line: int):
    """The function of that name (and scope) around ``line``, innermost first;
    else the only one of that name; else None."""
    named = [f for f in found if x.t[f[0]] == name and (scope is None or f[1] == scope)]
    inside = [f for f in named if x.place(f[2])[0] <= line <= x.end_line(f[4])]
    if inside:
        return min(inside, key=lambda f: x.at[f[4]] - x.at[f[2]])
    return named[0] if len(named) == 1 else None


def rust(finder: _RustFinder, hit: tuple, file: str, name: str, scope: str | None, line: int) -> tuple[dict, list[Step]]:
    at, _, first, brace, end = hit
    x, b = finder.x, RustBody(finder.x)
    opening = x.angles(at + 1)
    if x.tok(opening) != "(" or opening not in x.match:
        raise FlowError(f"the parameters of {name} ({file}, line {line}) can't be read")
    arrow = b.find(x.after(opening), brace, "->")
    where = b.find(arrow, brace, "where")
    info = {
        "name": name, "scope": scope, "file": file, "line": b.line(first), "end_line": x.end_line(end), "language": "rust",
        "params": b.parts(opening + 1, x.match[opening]), "returns": label(b.text(arrow + 1, where)) if arrow < where else None,
    }
    return info, b.block(brace, True)


def csharp(finder: _CSharpFinder, hit: tuple, file: str, name: str, scope: str | None, line: int) -> tuple[dict, list[Step]]:
    at, owner, first, body, end = hit
    x, b = finder.x, CSharpBody(finder.x)
    opening = x.angles(at + 1)
    if x.tok(opening) == "{":
        raise NoBody(f"{file}, line {line}: {name} only has accessors, so there are no statements to draw")
    k = first
    while x.tok(k) == "[":
        k = x.after(k)
    while x.tok(k) in CSharp._MODS:
        k += 1
    has = x.tok(opening) == "("
    if has and opening not in x.match:
        raise FlowError(f"the parameters of {name} ({file}, line {line}) can't be read")
    info = {
        "name": name, "scope": scope, "file": file, "line": b.line(first), "end_line": x.end_line(end), "language": "csharp",
        "params": b.parts(opening + 1, x.match[opening]) if has else [], "returns": label(b.text(k, at)) if k < at else None,
    }
    if x.t[body] == ";":
        raise NoBody(f"{file}, line {line}: {name} is declared without statements")
    if x.t[body] == "=>":
        stop = end if x.t[end] == ";" else end + 1
        value = b.valued(body + 1, stop)
        return info, [*value, Step("jump", b.line(body + 1), label(b.text(body + 1, stop)), node="return")]
    return info, b.block(body)


_LANGUAGES = {"rust": rust, "csharp": csharp}
_FINDERS = {"rust": _RustFinder, "csharp": _CSharpFinder}


def scan(language: str, source: str):
    if language not in _LANGUAGES:
        raise FlowError(f"no flow graphs for {language}, only for {' and '.join(_LANGUAGES)}")
    sys.setrecursionlimit(1_000_000)  # nested statements; calls between Python functions take no C stack
    finder = _FINDERS[language](source, language)
    finder.run()
    return finder


def functions(language: str, source: str, file: str):
    """Graphs of all functions of a text that have a body; where none can be made, ``error`` and where."""
    if language not in _LANGUAGES:
        return
    finder = scan(language, source)
    for hit in finder.found:
        name, line = finder.x.t[hit[0]], finder.x.place(hit[0])[0]
        try:
            info, steps = _LANGUAGES[language](finder, hit, file, name, hit[1], line)
            graph = Builder(info).build(steps)
        except NoBody:
            continue
        except (FlowError, LookupError) as e:
            # a text that does not parse may have functions without a graph
            yield {"function": {"name": name, "scope": hit[1], "line": line}, "nodes": None, "edges": None, "error": f"{type(e).__name__}: {e}"[:300]}
            continue
        yield {**graph, "error": None}


def flow(language: str, source: str, file: str, name: str, scope: str | None, line: int, scanned=None) -> dict:
    """``{function, nodes, edges}`` of one function; FlowError where there is none.

    ``scanned``: the source as ``scan`` gives it, where it is at hand.
    """
    finder = scanned or scan(language, source)
    hit = locate(finder.found, finder.x, name, scope, line)
    if hit is None:
        raise FlowError(f"{file} holds no function {name} around line {line}; perhaps it has changed since it was indexed")
    info, steps = _LANGUAGES[language](finder, hit, file, name, scope, line)
    return Builder(info).build(steps)


__all__ = ["flow", "locate", "one_line", "scan"]
