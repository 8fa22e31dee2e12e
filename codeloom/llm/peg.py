"""Packrat parsing-expression grammars over token kinds.

A grammar is text, one rule per line (``Name <- expression``; indented lines
continue a rule):

* ``'if'``        the token; ``IDENT NUM STR ...`` a kind; ``%name = ...`` a class of them
* ``A B``, ``A / B``, ``A* A+ A?``, ``&A !A``, ``( )``  as usual in PEGs
* ``@(Rule)``     brackets whose whole inside is ``Rule``; also ``@[ ]``, ``@{ }``,
  ``@:`` (indented block) and ``@"`` (hole in a string)
* ``Name! <- ..`` keeps results per position where choices share a start; rules that can reach
  themselves without entering brackets always do, so parsing takes linear time
* ``.``           any token outside brackets; ``END`` a closing bracket or the end of input
* ``ASSIGNABLE``  what has just been read ends like a target: in one of ``%target``, in ``]`` or
  ``}``, in a word after a dot, or in brackets that are no call; ``CALLED``: it ends in a call.
  ``%callee`` are the kinds after which a parenthesis is a call

The grammar is compiled to Python functions with first-set tests before every
alternative.  The packrat memo has two levels: per position, and, for
everything in brackets, per (rule, kinds inside).  No rule can see past a closing
bracket, so what is inside decides alone, and the memo may be kept from file to
file; it is cleared when full, which costs time only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from codeloom.lex.scanner import CLOSERS, EOF, HOLE, INDENT, OPENERS, Scanner, brackets

_TOKEN = re.compile(r"\s*(?:(')((?:[^'])+)'|(@[(\[{:\"])|(<-|[()\[\]{}/*+?&!.])|([A-Za-z_]\w*))")
_OPEN = {"@(": "(", "@[": "[", "@{": "{", "@:": INDENT, '@"': HOLE}
MEMO_ENTRIES = 150_000
MEMO_LENGTH = 1_500


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple = ()


class Grammar:
    def __init__(self, text: str, scanner: Scanner):
        self.scanner = scanner
        self.classes: dict[str, str] = {}
        self.rules: dict[str, Node] = {}
        self.kept: set[str] = set()
        lines: list[str] = []
        for line in text.splitlines():
            line = re.sub(r"\s+--.*", "", line)
            if line.startswith(" ") and lines:
                lines[-1] += line
            elif line.strip():
                lines.append(line)
        for line in lines:
            if line[0] == "%":
                name, spec = line[1:].split("=", 1)
                self.classes[name.strip()] = self._set(spec.split())
        for line in lines:
            if line[0] != "%":
                head, body = line.split("<-", 1)
                head = head.strip()
                if head.endswith("!"):
                    head = head[:-1]
                    self.kept.add(head)
                self._toks = [m for m in _TOKEN.finditer(body)]
                self._at = 0
                node = self._choice()
                if self._at != len(self._toks) or sum(len(m[0]) for m in self._toks) != len(body.rstrip()):
                    raise ValueError(f"bad rule {head}: {body}")
                self.rules[head] = node
        self.kept |= self._recursive()
        self.first = self._first_sets()
        self.start = next(iter(self.rules))
        self.fast, self.slow = self._compile(False), self._compile(True)
        self.memo: dict[tuple[str, str], bool] = {}

    def _kind(self, token: str) -> str:
        if token not in self.scanner.kinds:
            raise ValueError(f"no token {token!r} in {self.scanner.language}")
        return self.scanner.kinds[token]

    def _set(self, parts: list[str]) -> str:
        out = ""
        for p in parts:
            if p[0] == "'":
                out += self._kind(p[1:-1])
            elif p == "WORDS":
                out += "".join(self.scanner.words.values())
            else:
                out += self.classes.get(p) or _KINDS[p]
        return out

    # -- reading -------------------------------------------------------------
    def _peek(self) -> str:
        if self._at == len(self._toks):
            return ""
        m = self._toks[self._at]
        return "'" if m[1] else m[3] or m[4] or m[5]

    def _choice(self) -> Node:
        alts = [self._seq()]
        while self._peek() == "/":
            self._at += 1
            alts.append(self._seq())
        return alts[0] if len(alts) == 1 else Node("choice", tuple(alts))

    def _seq(self) -> Node:
        parts = []
        while self._peek() not in ("", "/", ")", "]", "}"):
            parts.append(self._prefixed())
        return parts[0] if len(parts) == 1 else Node("seq", tuple(parts))

    def _prefixed(self) -> Node:
        p = self._peek()
        if p in ("&", "!"):
            self._at += 1
            return Node("and" if p == "&" else "not", (self._suffixed(),))
        return self._suffixed()

    def _suffixed(self) -> Node:
        node = self._primary()
        while (p := self._peek()) in ("*", "+", "?") and p:
            self._at += 1
            node = Node({"*": "star", "+": "plus", "?": "opt"}[p], (node,))
        return node

    def _primary(self) -> Node:
        m = self._toks[self._at]
        self._at += 1
        if m[1]:
            return Node("set", (self._kind(m[2]),))
        if m[3]:
            inner = self._toks[self._at][5]
            self._at += 1
            if m[3] in ("@(", "@[", "@{"):
                self._at += 1  # the closing bracket
            return Node("group", (_OPEN[m[3]], inner))
        if m[4] == "(":
            node = self._choice()
            self._at += 1
            return node
        if m[4] == ".":
            return Node("any")
        if m[5] in ("END", "ASSIGNABLE", "CALLED"):
            return Node(m[5].lower())
        if m[5] in self.classes or m[5] in _KINDS:
            return Node("set", (self.classes.get(m[5]) or _KINDS[m[5]],))
        return Node("rule", (m[5],))

    def _recursive(self) -> set[str]:
        """Rules that can reach themselves without entering brackets."""

        def calls(n) -> set[str]:
            if n.op == "rule":
                return {n.args[0]}
            return set().union(*(calls(a) for a in n.args)) if n.op not in ("set", "group") else set()

        reach = {r: calls(n) & set(self.rules) for r, n in self.rules.items()}
        while True:
            new = {r: to.union(*(reach[x] for x in to)) for r, to in reach.items()}
            if new == reach:
                return {r for r, to in reach.items() if r in to}
            reach = new

    # -- first sets ----------------------------------------------------------
    def _first_sets(self) -> dict[str, frozenset | None]:
        """Kinds a rule can begin with; None where it may match nothing (or look ahead only)."""
        known: dict[str, tuple[frozenset, bool]] = {r: (frozenset(), False) for r in self.rules}
        everything = frozenset({"*"})

        def of(n: Node) -> tuple[frozenset, bool]:
            if n.op == "set":
                return frozenset(n.args[0]), False
            if n.op == "group":
                return frozenset(n.args[0]), False
            if n.op == "any":
                return everything, False
            if n.op in ("end", "and", "not", "assignable", "called"):
                return frozenset(), True
            if n.op == "rule":
                if n.args[0] not in known:
                    raise ValueError(f"no rule {n.args[0]}")
                return known[n.args[0]]
            if n.op in ("star", "opt"):
                return of(n.args[0])[0], True
            if n.op == "plus":
                return of(n.args[0])
            if n.op == "choice":
                got = [of(a) for a in n.args]
                return frozenset().union(*(g[0] for g in got)), any(g[1] for g in got)
            out, empty = frozenset(), True
            for a in n.args:
                f, e = of(a)
                out |= f
                if not e:
                    empty = False
                    break
            return out, empty

        while True:
            new = {r: of(n) for r, n in self.rules.items()}
            if new == known:
                break
            known = new
        self._of = of
        return {r: None if e or "*" in f else f for r, (f, e) in known.items()}

    def _guard(self, n: Node) -> str | None:
        f, e = self._of(n)
        return None if e or "*" in f else "".join(sorted(f))

    # -- compiling -----------------------------------------------------------
    def _compile(self, track: bool):
        out = ["def make(K, M, group, far, back):"]
        self._n = 0

        def fresh() -> str:
            self._n += 1
            return f"t{self._n}"

        def miss(src: str, ind: str) -> list[str]:
            return [f"{ind}if {src} > far[0]: far[0] = {src}"] if track else []

        def emit(n: Node, src: str, dst: str, ind: str) -> list[str]:
            one = ind + " "
            if n.op == "set":
                test = f"K[{src}] == {n.args[0]!r}" if len(n.args[0]) == 1 else f"K[{src}] in {n.args[0]!r}"
                return [f"{ind}if {test}: {dst} = {src} + 1", f"{ind}else:", f"{one}{dst} = -1", *miss(src, one)]
            if n.op == "any":
                return [f"{ind}{dst} = {src} + 1 if K[{src}] not in {CLOSERS + EOF!r} else -1"]
            if n.op == "end":
                return [f"{ind}{dst} = {src} if K[{src}] in {CLOSERS + EOF!r} else -1", *([f"{ind}if {dst} < 0:", *miss(src, one)] if track else [])]
            if n.op in ("assignable", "called"):
                return [f"{ind}{dst} = {src} if back({src}, {n.op == 'called'}) else -1"]
            if n.op == "rule":
                return [f"{ind}{dst} = r_{n.args[0]}({src})"]
            if n.op == "group":
                return [f"{ind}if K[{src}] == {n.args[0]!r}: {dst} = group({src}, {n.args[1]!r})", f"{ind}else:", f"{one}{dst} = -1", *miss(src, one)]
            if n.op == "seq":
                lines, cur = [f"{ind}{dst} = -1"], src
                for k, a in enumerate(n.args):
                    nxt = dst if k == len(n.args) - 1 else fresh()
                    lines += emit(a, cur, nxt, ind)
                    if k < len(n.args) - 1:
                        lines.append(f"{ind}if {nxt} >= 0:")
                        ind, cur = ind + " ", nxt
                return lines
            if n.op == "choice":
                lines = [f"{ind}{dst} = -1"]
                if all(self._guard(a) for a in n.args) and len(n.args) > 2 and not track:
                    c = fresh()
                    lines.append(f"{ind}{c} = K[{src}]")
                else:
                    c = f"K[{src}]"
                for k, a in enumerate(n.args):
                    g = self._guard(a)
                    test = [f"{dst} < 0"] if k else []
                    if g and not (track and a.op == "set"):
                        test.append(f"{c} in {g!r}" if len(g) > 1 else f"{c} == {g!r}")
                    if test:
                        lines.append(f"{ind}if {' and '.join(test)}:")
                        lines += emit(a, src, dst, ind + " ")
                    else:
                        lines += emit(a, src, dst, ind)
                if track:
                    lines += [f"{ind}if {dst} < 0:", *miss(src, one)]
                return lines
            if n.op in ("star", "plus"):
                t, lines = fresh(), []
                if n.op == "plus":
                    lines += emit(n.args[0], src, dst, ind)
                    lines.append(f"{ind}while {dst} >= 0:")
                else:
                    lines += [f"{ind}{dst} = {src}", f"{ind}while True:"]
                g = self._guard(n.args[0])
                if g:
                    lines += [f"{one}if K[{dst}] not in {g!r}:", *miss(dst, one + " "), f"{one} break"]
                lines += emit(n.args[0], dst, t, one)
                return [*lines, f"{one}if {t} <= {dst}: break", f"{one}{dst} = {t}"]
            if n.op == "opt":
                t = fresh()
                g = self._guard(n.args[0])
                lines = [f"{ind}{dst} = {src}"]
                if g:
                    lines.append(f"{ind}if K[{src}] in {g!r}:")
                    lines += [*emit(n.args[0], src, t, one), f"{one}if {t} >= 0: {dst} = {t}"]
                    return lines + ([f"{ind}else:", *miss(src, one)] if track else [])
                return [*lines, *emit(n.args[0], src, t, ind), f"{ind}if {t} >= 0: {dst} = {t}"]
            t = fresh()
            return [*emit(n.args[0], src, t, ind), f"{ind}{dst} = {src} if {t} {'>=' if n.op == 'and' else '<'} 0 else -1"]

        for name, node in self.rules.items():
            if name in self.kept:
                out += [f" m_{name} = {{}}", f" def r_{name}(i):", f"  r = m_{name}.get(i)", "  if r is not None: return r", *emit(node, "i", "r", "  "), f"  m_{name}[i] = r", "  return r"]
            else:
                out += [f" def r_{name}(i):", *emit(node, "i", "r", "  "), "  return r"]
        out.append(" return {" + ", ".join(f"{r!r}: r_{r}" for r in self.rules) + "}")
        env: dict = {}
        exec(compile("\n".join(out), f"<grammar {self.scanner.language}>", "exec"), env)
        return env["make"]

    # -- parsing -------------------------------------------------------------
    def _back(self, kinds: str, match: dict[int, int]):
        """What ``ASSIGNABLE`` and ``CALLED`` ask about the token before a position."""
        openers: dict[int, int] = {}
        target, callee = self.classes.get("target", ""), self.classes.get("callee", "")
        words, dot, maybe = "".join(self.scanner.words.values()), self.scanner.kinds.get("."), self.scanner.kinds.get("?.")

        def back(i: int, called: bool) -> bool:
            c, before = kinds[i - 1], kinds[i - 2] if i > 1 else EOF
            if c == ")":
                if not openers:
                    openers.update((b, a) for a, b in match.items())
                at = openers.get(i - 1, 0)
                return (at > 0 and kinds[at - 1] in callee) == called
            if called or before == maybe:
                return False
            return c in "]}" or (before == dot if c in words and c not in target else c in target)

        return back

    def accepts(self, kinds: str, match: dict[int, int] | None = None) -> bool:
        match = brackets(kinds) if match is None else match
        memo, here = self.memo, {}

        def group(i: int, rule: str) -> int:
            j = match.get(i)
            if j is None:
                return -1
            if j - i > MEMO_LENGTH:  # long insides are kept for this text only, by position
                ok = here.get((rule, i))
                if ok is None:
                    ok = here[rule, i] = parse[rule](i + 1) == j
                return j + 1 if ok else -1
            key = (rule, kinds[i + 1 : j])
            ok = memo.get(key)
            if ok is None:
                ok = parse[rule](i + 1) == j
                if len(memo) >= MEMO_ENTRIES:
                    memo.clear()
                memo[key] = ok
            return j + 1 if ok else -1

        parse = self.fast(kinds, match, group, None, self._back(kinds, match))
        return parse[self.start](0) == len(kinds) - 1

    def furthest(self, kinds: str) -> int:
        """Position of the furthest failure of a text that is not accepted."""
        match, here = brackets(kinds), {}
        far = [0]

        def group(i: int, rule: str) -> int:
            end = here.get((rule, i))
            if end is None:
                j, end = match.get(i), parse[rule](i + 1)
                if j is None or end != j:
                    far[0] = max(far[0], i + 1 if end < 0 else end)
                    end = -1
                else:
                    end = j + 1
                here[rule, i] = end
            return end

        parse = self.slow(kinds, match, group, far, self._back(kinds, match))
        end = parse[self.start](0)
        return max(far[0], end)


_KINDS = {"IDENT": "a", "NUM": "0", "STR": '"', "CHAR": "'", "REGEX": "/", "TEMPLATE": "`", "NL": "n", "SOFT": "N", "LIFE": "L", "OPEN": OPENERS}
