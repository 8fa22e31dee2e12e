"""Tolerant scanners for seven languages.

A scanner turns text into tokens with one compiled pattern and tokens into
*kinds*: a string with one character per token, so everything after it (layout,
bracket matching, grammars, declaration scans) works on a short string.  All
identifiers share a kind, each keyword and operator has its own.  A token that
no rule of the language allows has the kind ``BAD``.

The pattern takes nested literals and comments only as deep as a regular
expression can; where it gives up, ``Scanner.exact`` scans again with a stack.

A strict scanner tells apart what only a syntax check needs: words that are
keywords in some places, bytes and text, expressions inside Python and C#
strings, and whether a regular expression is one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

IDENT, NUM, STR, CHAR, REGEX, TEMPLATE, BAD, NEWLINE, SOFT = "a", "0", '"', "'", "/", "`", "\ufffd", "n", "N"
INDENT, DEDENT, HOLE, HOLE_END, EOF = "\u2aa1", "\u2aa2", "\u00ab", "\u00bb", "\x00"
OPENERS, CLOSERS = "([{" + INDENT + HOLE, ")]}" + DEDENT + HOLE_END
#: Python newline kinds carry the indentation of the line that follows.
_NL0, _NL1 = "\uf000", "\uf7ff"

# fixed values: keywords and operators of the languages
KEYWORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "javascript": "await break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield "
    "as async from get let of set static",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while macro_rules union raw",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "swift": "associatedtype class deinit enum extension fileprivate func import init inout internal let open operator private precedencegroup protocol public rethrows static struct subscript typealias var break case catch continue default defer do else fallthrough for guard if in repeat return throw switch where while as await false is nil self Self super throws true try _ "
    "actor async convenience didSet dynamic final get indirect infix lazy mutating nonmutating optional override postfix prefix required set some any unowned weak willSet consuming borrowing nonisolated isolated package each macro",
    "csharp": "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while "
    "add alias and ascending async await by descending dynamic equals file from get global group init into join let managed nameof not notnull on or orderby partial record remove required scoped select set unmanaged value var when where with yield",
}
KEYWORDS["typescript"] = KEYWORDS["javascript"] + " abstract accessor any asserts boolean declare enum implements infer interface is keyof module namespace never number object override private protected public readonly satisfies string symbol type undefined unique unknown"
OPERATORS = {
    "python": "**= //= >>= <<= ... -> := ** // >> << <= >= == != += -= *= /= %= &= |= ^= @= + - * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; =",
    "javascript": ">>>= ... === !== **= <<= >>= &&= ||= ??= => == != <= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << ** { } ( ) [ ] . ; , < > + - * / % & | ^ ! ~ ? : = @ #",
    "rust": "<<= ... ..= :: -> => == != <= && || += -= *= /= %= ^= &= |= << .. + - * / % ^ ! & | = < > @ . , ; : # $ ? ( ) [ ] { } ~",
    "go": "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ + - * / % & | ^ < > = ! ( ) [ ] { } , ; . : ~",
    "swift": "... ..< === !== &&= ||= <<= >>= -> == != <= >= && || ?? += -= *= /= %= &= |= ^= &+ &- &* << + - * / % = < > ! & | ^ ~ ? ( ) [ ] { } , : ; . @ # $ \\",
    "csharp": "<<= ??= => == != <= && || ++ -- += -= *= /= %= &= |= ^= << -> ?? ?. :: .. + - * / % & | ^ ! ~ < > = ? : ; , . ( ) [ ] { } @ #",
}
OPERATORS["typescript"] = OPERATORS["javascript"]
#: Keywords of a strict scanner besides.
SOFT_WORDS = {"python": "case match type"}

_LINE, _BLOCK = r"//[^\n]*", r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"


def _nested(depth: int = 6) -> str:
    """Block comments that nest."""
    body = r"(?:[^*/]|\*(?!/)|/(?!\*))*+"
    pattern = rf"/\*{body}\*/"
    for _ in range(depth):
        pattern = rf"/\*(?>[^*/]|\*(?!/)|/(?!\*)|{pattern})*+\*/"
    return pattern


_SKIP = {
    "python": r"[ \t\f]+|#[^\n]*|\\\n",
    "javascript": rf"[ \t\f\v\u00a0\ufeff\u2028\u2029]+|{_LINE}|{_BLOCK}",
    "rust": rf"\s+|{_LINE}|{_nested()}",
    "go": rf"[ \t\r]+|{_LINE}|{_BLOCK}",
    "swift": rf"[ \t\f\v\0]+|{_LINE}|{_nested()}",
    "csharp": rf"[\s\ufeff]+|{_LINE}|{_BLOCK}|(?<![^\n])[ \t]*\#[^\n]*",
}
_SKIP["typescript"] = _SKIP["javascript"]

_DQ = r'"(?:[^"\\\n]|\\[^\n]|\\\n)*"'
# what these take is exact; deeper or ambiguous texts are left to ``Scanner.exact``
_IN = r"""[^{}`"'/]++|"(?:[^"\\\n]|\\[^\n])*+"|'(?:[^'\\\n]|\\[^\n])*+'|`[^`\\$]*+`"""
_TPL_HOLE = rf"(?:{_IN}|\{{(?:{_IN})*+\}})*+"
_TPL = rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{{_TPL_HOLE}\}})*+`"
_SIN = r'[^()"/{}]|/(?![/*])|"[^"\\\n]*+"'
_HOLE = rf'\\\((?:[^()"\n/{{}}]|/(?![/*])|"[^"\\\n]*+"|\((?:{_SIN}|\((?:{_SIN}|\((?:{_SIN})*+\))*+\))*+\))*+\)'
_PY = r"(?i:[rbu]|br|rb)?"
_PF = r"(?i:f|fr|rf)"
_BODY1 = r"(?:[^{Q\\\n]|\\[\s\S]|\{\{|\{(?:[^{}\nQ]|\"[^\"\n]*\"|'[^'\n]*'|\{[^{}\n]*\})*\})*"
_LITERALS = {
    "python": rf'{_PF}"""(?:[^\\]|\\[\s\S])*?"""|{_PF}\'\'\'(?:[^\\]|\\[\s\S])*?\'\'\'|{_PF}"{_BODY1.replace("Q", chr(34))}"|{_PF}\'{_BODY1.replace("Q", chr(39))}\''
    rf'|{_PY}"""(?:[^\\]|\\[\s\S])*?"""|{_PY}\'\'\'(?:[^\\]|\\[\s\S])*?\'\'\'|(?:{_PY}|{_PF}){_DQ}|(?:{_PY}|{_PF})\'(?:[^\'\\\n]|\\[\s\S])*\'',
    "javascript": rf"{_DQ}|'(?:[^'\\\n]|\\[\s\S])*'|{_TPL}",
    "rust": r'[bc]?r"[^"]*"|[bc]?r\#"(?:[^"]|"(?!\#))*"\#|[bc]?r\#\#"(?:[^"]|"(?!\#\#))*"\#\#|[bc]?r\#\#\#"(?:[^"]|"(?!\#\#\#))*"\#\#\#|[bc]?r\#+"|r\#[A-Za-z_]\w*|[bc]?"(?:[^"\\]|\\[\s\S])*"|b?\'(?:[^\'\\\n]|\\(?:u\{[^}]*\}|x[0-9a-fA-F]{2}|[^\n]))\'|\'[A-Za-z_]\w*(?!\')',
    "go": r"\"(?:[^\"\\\n]|\\[^\n])*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n][0-9a-fA-F]*)'",
    "swift": rf'\#"(?:[^"\n\\]|"(?!\#)|\\(?!\#))*"\#|\#+"|"""\n(?:[^"\\]|{_HOLE}|\\[^(]|"(?!""))*"""|(?!"""\n)"(?:[^"\\\n]|{_HOLE}|\\[^(\n])*"|`\w+`',
    "csharp": r'\$*"""+(?:[^"]|"{1,2}(?!"))*"""+|(?:\$@|@\$|@)"(?:[^"]|"")*"|\$"(?:[^"\\\n{]|\\[^\n]|\{\{|\{(?:[^{}"\n]|"[^"\n]*"|\{[^{}\n]*\})*\})*"(?:u8)?|"(?:[^"\\\n]|\\[^\n])*"(?:u8)?|\'(?:[^\'\\\n]|\\[^\n][0-9a-fA-F]*)\'|@[A-Za-z_]\w*',
}
_LITERALS["typescript"] = _LITERALS["javascript"]

#: What opens a literal or comment that may nest.
_NESTS = {
    "python": r"(?i:f|fr|rf)(?:\"{3}|'{3}|\"|')",
    "javascript": "`",
    "rust": r'[bc]?r\#*"|/\*',
    "swift": r'\#*"""(?=\n)|\#*"|/\*',
    "csharp": r'\$*"{3,}|(?:\$@|@\$|\$)"',
}
_NESTS["typescript"] = _NESTS["javascript"]

_NUMBERS = {
    "python": r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?[jJ]?|\d(?:_?\d)*[eE][+-]?\d+[jJ]?|\d(?:_?\d)*[jJ]|0(?:_?0)*|[1-9](?:_?\d)*)(?!\w)",
    "javascript": r"(?:0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:(?:0|[1-9][\d_]*)(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?|(?:0|[1-9][\d_]*)n)(?![\w$])",
    "rust": r"(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w)",
    "go": r"(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w)",
    "swift": r"(?:0x[0-9a-fA-F_]+(?:\.[0-9a-fA-F_]+)?(?:[pP][+-]?\d+)?|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)(?!\w)",
    "csharp": r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)(?:[uU][lL]?|[lL][uU]?|[fFdDmM])?(?!\w)",
}
_NUMBERS["typescript"] = _NUMBERS["javascript"]

_JSRE = r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*"
_JSRE_FIRST = re.compile(rf"\s*+({_JSRE})")
_JSRE_AFTER = r"=>|&&|\|\||\?\?|===?|!==?|[(,=:\[!&|?{;+\-*%~^<>]|\b(?:return|typeof|case|in|of|delete|void|throw|else|do|await|yield)\b"

#: Prior kinds after which a newline ends a Go statement; and tokens that carry an expression on or can't begin one.
_GO_END = "ident literal break continue fallthrough return ++ -- ) ] }"
_CONTINUES = {
    "javascript": "( [ . ?. , ; ) ] } : ? = => == != === !== <= < > + - * / % & | ^ && || ?? += -= *= /= %= &= |= ^= ** **= << instanceof in as satisfies",
    "swift": ". , ) ] } : ? = == != <= >= < > + - * / % & | ^ && || ?? += -= *= /= %= -> ... ..< in else catch where is as",
}
_CONTINUES["typescript"] = _CONTINUES["javascript"]
#: Tokens after which a statement can't end.
_OPEN_END = {
    "javascript": "( [ { . ?. , ; : ? = => == != === !== <= < + - * / % & | ^ && || ?? += -= *= /= %= &= |= ^= ** **= << ! ~ typeof new delete void instanceof in else do try finally const let var function class import export extends case ... @ #",
    "swift": "( [ { . , ; : = == != <= >= + - * / % & | ^ && || ?? += -= *= /= %= -> ... ..< ~ else do defer repeat let var func class struct enum protocol extension import case in is as guard if while for switch @ #",
}
# both end a statement in TypeScript: a type, and `as const`
_OPEN_END["typescript"] = _OPEN_END["javascript"].replace(" void ", " ").replace(" const ", " ")


@dataclass
class Scanner:
    language: str
    strict: bool = False
    kinds: dict[str, str] = field(default_factory=dict)
    seen: list[str] = field(default_factory=list)
    #: the last text scanned with its kinds before layout and what layout replaced
    last: tuple = (None, "", (), None)

    def __post_init__(self):
        lang = self.language
        ops, words = OPERATORS[lang].split(), KEYWORDS[lang].split()
        words += SOFT_WORDS.get(lang, "").split() if self.strict else []
        code = 0xE000
        for t in [*words, *ops]:
            if len(t) == 1 and t in "()[]{},;:.=<>":
                self.kinds[t] = t
            elif t not in self.kinds:
                self.kinds[t] = chr(code)
                code += 1
        self.words = {w: self.kinds[w] for w in words}
        ident = r"[^\W\d]\w*+" if lang in ("python", "go", "rust", "csharp", "swift") else r"[$\w]++"
        start = rf"(?!\d){ident}"
        newline = r"\n[ \t\f]*" if lang == "python" else r"\n\s*" if lang not in ("rust", "csharp") else r"(?!)"
        first = rf"(?!\w++\s*+[^/\s])(?:{_JSRE_AFTER})(?:\s|{_LINE}|{_BLOCK})*+{_JSRE}|" if lang in ("javascript", "typescript") else ""
        ordered = "|".join(re.escape(o) for o in sorted(ops, key=len, reverse=True))
        # brackets, comma and semicolon begin no longer operator, and only these characters begin a literal
        single = r"[()\[\]{},;]"
        begins = {"python": r"[\w\"']", "rust": r"[\w\"']", "go": r"[\"'`]", "swift": r"[#\"`]", "csharp": r"[$@\"']"}.get(lang, r"[\"'`]")
        # a comment deeper than the pattern goes is a token, so that it is seen
        deep = r"/\*|" if lang in ("rust", "swift") else ""
        skip = _SKIP[lang].replace("|" + _nested(), "")
        rest = (
            rf"{r"[)\]}]|[(\[{,;](?!\s*+/)|" + first if first else single + "|"}{start}(?![\"'#])|(?={begins})(?:{_LITERALS[lang]})|(?=[\d.])(?:{_NUMBERS[lang]}|\d\w*)|{single}|{start}|{newline}|{deep}{ordered}|[^\s]|\Z"
        )
        self.pattern = re.compile(rf"(?:{_SKIP[lang]})*+({rest})")
        self.nest = re.compile(_NESTS[lang]) if lang in _NESTS else None
        self._opens = rf"(?:{skip})*+((?P<nest>{_NESTS.get(lang)})|{rest})"
        self.cache: dict[str, str] = _Cache(self._kind)
        self.k = lambda spec: "".join(IDENT if t == "ident" else NUM + STR + CHAR + REGEX + TEMPLATE if t == "literal" else self.kinds.get(t, "") for t in spec.split())
        if lang == "go":
            self.ends = self.k(_GO_END)
        elif lang in _CONTINUES:
            self.carry, self.open_end = self.k(_CONTINUES[lang]), self.k(_OPEN_END[lang]) + NEWLINE
            self.carry, self.open_end = self.carry + HOLE_END, self.open_end + HOLE

    @cached_property
    def opens(self) -> re.Pattern:
        """The pattern with openers in place of literals that may nest; few texts need it."""
        return re.compile(self._opens)

    def _kind(self, t: str) -> str:
        fixed = self.kinds.get(t)
        if fixed:
            return fixed
        if not t:
            return ""  # the end, after trailing comments
        c, lang = t[0], self.language
        if c == "\n":
            return chr(min(ord(_NL1), ord(_NL0) + len(t[1:].expandtabs(8)))) if lang == "python" else NEWLINE
        if lang in ("javascript", "typescript"):
            if c == "`" and len(t) > 1:
                return TEMPLATE + self._holes(re.findall(rf"\\.|\$\{{({_TPL_HOLE})\}}", t[1:-1], re.S))
            if c == "/" and len(t) > 1:
                return REGEX if not self.strict or _is_regex(t) else BAD
            if (m := re.match(_JSRE_AFTER, t)) and t[-1] != t[0] and "/" in t and c not in "\"'":
                return self.cache[m[0]] + (REGEX if not self.strict or _is_regex(re.search(rf"{_JSRE}\Z", t)[0]) else BAD)
        if lang == "rust":
            if c == "'":
                return CHAR if len(t) > 2 and t[-1] == "'" else "L" if len(t) > 1 else BAD
            if t[-1] == '"' and t[-2:-1] == "#" and '"' not in t[:-1]:
                return BAD
            if t.startswith("r#") and not t.endswith("#"):
                return IDENT
        if t == "/*":
            return BAD
        if lang == "swift":
            if c == "#" and t[-1] == '"':
                return BAD
            if c == "`" and len(t) > 2:
                return IDENT
            if c == '"' and "\\(" in t:
                return STR + self._holes(m[2:-1] for m in re.findall(rf"\\[^(]|({_HOLE})", t))
        if lang == "csharp" and c == "@" and len(t) > 1 and t[1] not in '"$':
            return IDENT
        if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
            return NUM if re.fullmatch(_NUMBERS[lang], t) else BAD
        if self.strict and lang in ("python", "csharp") and (m := _STRING.match(t)) and len(t) > 1:
            return self._string(t, m)
        if c == '"' or t[-1] in "\"'" and len(t) > 1 or t.endswith('"u8'):
            if len(t) == 1 or (c in "\"'" and t[-1] != c and not t.endswith("u8")):
                return BAD
            return CHAR if c == "'" and lang in ("go", "csharp") else STR
        if c == "#" and len(t) > 2:
            return STR
        if c == "`" and lang == "go" and len(t) > 1:
            return STR
        if c == "_" or c == "$" and lang in ("javascript", "typescript", "swift") or c.isidentifier():
            return IDENT
        return BAD

    def _string(self, t: str, m: re.Match) -> str:
        """Kinds of a whole string literal with the expressions inside, for strict scanners."""
        lead, q = m[1], m[2]
        end = t.removesuffix("u8")
        if len(end) < len(lead) + 2 * len(q) or not end.endswith(q):
            return BAD
        body = end[len(lead) + len(q) : -len(q)]
        if self.language == "csharp":
            if q == "'":
                return CHAR
            if "$" not in lead:
                return STR
            got = _Holes(self, body, lead.count("$") if len(q) > 2 else 1, "@" in lead or len(q) > 2).kinds()
            return STR + got if got is not None else BAD
        lead = lead.lower()
        if "b" in lead:
            return CHAR if body.isascii() else BAD
        if "f" not in lead:
            return STR
        got = _Holes(self, body, 1, "r" in lead).kinds()
        return STR + got if got is not None else BAD

    def expressions(self, t: str) -> list[tuple[int, str]]:
        """(start, text) of the expressions inside a Python literal, none where it has none or is not well formed."""
        m = _STRING.match(t)
        if m is None or "f" not in m[1].lower() or "{" not in t:
            return []
        first = m.end()
        holes = _Holes(self, t[first : -len(m[2])], 1, "r" in m[1].lower())
        return [(first + a, holes.body[a:b]) for a, b in holes.spans] if holes.kinds() is not None else []

    def inside(self, text: str) -> str:
        """Kinds of an expression inside a string; line ends don't count there."""
        if '"' in text or "'" in text:
            got = [(t, k) for _, t, k in self.exact(text)]
        else:
            got = [(t, self.cache[t]) for t in self.pattern.findall(text) if t]
        return "".join(k for t, k in got if t[0] != "\n")

    def _holes(self, parts) -> str:
        """Kinds of the expressions inside a string."""
        return "".join(HOLE + "".join(map(self.cache.__getitem__, self.pattern.findall(p))) + HOLE_END for p in parts if p.strip())

    def tokens(self, text: str) -> list[str]:
        return self.pattern.findall(clean(text, self.language))

    def raw(self, text: str) -> str:
        return "".join(map(self.cache.__getitem__, self.tokens(text)))

    def doubtful(self, t: str) -> bool:
        """Whether the pattern may have cut a literal or comment short with this token."""
        if self.nest is None:
            return False
        lang, m = self.language, self.nest.match(t)
        if BAD in self.cache[t]:
            return m is not None or lang in ("python", "csharp") and t in "\"'$@"
        if m is None or lang not in ("python", "csharp"):
            return False
        return "{" in t if "$" in m[0] or lang == "python" else len(m[0]) > 3

    def places(self, text: str) -> list[tuple[int, str, str]]:
        """(start, token, kinds) of a clean text, scanned exactly where the pattern gave up."""
        got = [(m.start(1), m[1], self.cache[m[1]]) for m in self.pattern.finditer(text) if m[1]]
        return self.exact(text) if any(BAD in k and self.doubtful(t) for _, t, k in got) else got

    def exact(self, text: str) -> list[tuple[int, str, str]]:
        """(start, token, kinds) of a clean text; literals and comments nest to any depth.

        A literal that never ends falls with all it is nested in, and its opener
        becomes what the pattern makes of it.
        """
        lang, out, stack, failed, pos = self.language, [], [], set(), 0
        loose = lang in ("python", "csharp")
        comments: dict[int, int | None] = {}
        while True:
            top = stack[-1] if stack else None
            ok = True
            if top and not top.hole:
                if m := top.chunk.match(text, pos):
                    pos = m.end()
                    if m[1] is None:
                        top.hole, top.own, top.all = True, 0, 0
                        top.kinds.append(HOLE)
                        if lang in ("javascript", "typescript") and (m := _JSRE_FIRST.match(text, pos)):
                            top.kinds.append(REGEX)
                            pos = m.end()
                    else:
                        stack.pop()
                        if top.spec:
                            stack[-1].hole = False
                            continue
                        k = TEMPLATE if text[top.start] == "`" else STR
                        if lang not in ("python", "csharp"):
                            k += "".join(top.kinds)
                        elif self.strict and not stack:  # what lies in it is read with it
                            t = text[top.start : pos]
                            k = self._string(t, _STRING.match(t))
                        if stack:
                            stack[-1].kinds.append(k)
                        else:
                            out.append((top.start, text[top.start : pos], k))
                    continue
                ok = False
            else:
                if top:
                    m = self.opens.search(text, pos)
                    t, start, end = m[1], m.start(1), m.end()
                    opens = m["nest"] is not None and start not in failed
                else:
                    for m in self.pattern.finditer(text, pos):
                        t, start = m[1], m.start(1)
                        if loose and start not in failed and (m := self.nest.match(text, start)):
                            break
                        k = self.cache[t]
                        if BAD in k and not loose and start not in failed and (m := self.nest.match(text, start)):
                            break
                        if t:
                            out.append((start, t, k))
                    else:
                        return out
                    t, end, opens = m[0], m.end(), True
                if opens:
                    if t == "/*":
                        if start not in comments:
                            comments.update(_comment_ends(text, start))
                        pos = comments[start]
                        if pos is None:
                            pos = start
                            failed.add(start)
                    else:
                        stack.append(_Open(start, re.compile(_chunk(lang, t)), t.count("$") or 1 if lang == "csharp" else 1, lang == "swift" and '"""' not in t))
                        pos = end
                    continue
                if start in failed:
                    m = self.pattern.match(text, start)
                    t = m[1]
                if not t:
                    ok = False
                else:
                    k = self.cache[t]
                    c, pos = k[:1], m.end()
                    if c == (")" if lang == "swift" else "}") and not top.own:
                        pos = start + top.width
                        ok = text.startswith("}" * top.width, start) or lang == "swift"
                        top.hole = False
                        if top.kinds[-1] == HOLE:
                            top.kinds.pop()
                        else:
                            top.kinds.append(HOLE_END)
                    elif not top.all and (t == ":" and lang in ("python", "csharp") or t == ":=" and lang == "python"):
                        pos = start + 1
                        stack.append(_Open(start, re.compile(r"[^{}]*+(?:(\}{%d})|\{)" % top.width), 1, False, True))
                    elif top.line and t[0] == "\n" and not top.all:
                        ok = False
                    else:
                        step = (c in ("(", "[", "{")) - (c in (")", "]", "}"))
                        top.all += step
                        top.own += step if c in ("()" if lang == "swift" else "{}") else 0
                        top.kinds.append(k)
            if not ok:
                failed.update(f.start for f in stack)
                pos = stack[0].start
                stack.clear()

    def scan(self, text: str) -> str:
        """Kinds after layout, closed by ``EOF``."""
        self.seen = self.tokens(text)
        return self._laid_out(text, "".join(map(self.cache.__getitem__, self.seen)), None)

    def rescan(self, text: str) -> str | None:
        """Kinds of the text just scanned by an exact scan, null where it can't differ."""
        if not any(map(self.doubtful, set(self.seen))):
            return None
        got = self.exact(clean(text, self.language))
        return self._laid_out(text, "".join(k for _, _, k in got), got)

    def rescan_elements(self, text: str) -> str | None:
        """Kinds of the text with its JSX elements as templates, null where it has none that are well formed."""
        body = clean(text, self.language)
        got: list[tuple[int, str, str]] = []
        if self._with_elements(body, 0, got, False) is None or not any(t[0] == "<" and len(t) > 1 for _, t, _ in got):
            return None
        return self._laid_out(text, "".join(k for _, _, k in got), got)

    def _with_elements(self, text: str, pos: int, out: list, inside: bool) -> int | None:
        """Scan from ``pos`` into ``out``, to the end or (``inside``) to the closing brace; the place behind."""
        depth = 0
        before = self.k("( [ { , ; : ? = => && || ?? ! return default case yield await else do") + NEWLINE
        while True:
            m = self.pattern.match(text, pos)
            t, start, pos = m[1], m.start(1), m.end()
            if not t:
                return None if inside else pos
            if t == "<" and _ELEMENT.match(text, start):
                prior = next((k for _, _, k in reversed(out) if k != NEWLINE), NEWLINE)
                got = self._element(text, start) if prior[-1] in before else None
                if got:
                    pos = got[0]
                    out.append((start, text[start:pos], got[1]))
                    continue
            depth += (t == "{") - (t == "}")
            if inside and depth < 0:
                return pos
            out.append((start, t, self.cache[t]))

    def _element(self, text: str, at: int) -> tuple[int, str] | None:
        """The place behind the element that opens at ``at``, and its kinds: a template with the expressions in it."""
        m = _ELEMENT.match(text, at)
        name, pos, holes = m[1], m.end(), []

        def hole(i: int) -> int | None:
            got: list = []
            end = self._with_elements(text, i + 1, got, True)
            kinds = "".join(k for _, t, k in got if t != "...")
            if end is not None and kinds.strip(NEWLINE):
                # line ends don't count in brackets of an expression's own
                holes.append(HOLE + kinds.strip(NEWLINE) + HOLE_END)
            return end

        def element(i: int) -> int | None:
            got = self._element(text, i) if _ELEMENT.match(text, i) else None
            if got:
                holes.append(HOLE + got[1] + HOLE_END)
            return got[0] if got else None

        if text.startswith("<", pos):  # type arguments
            depth = 0
            for pos in range(pos, len(text)):
                depth += (text[pos] == "<") - (text[pos] == ">")
                if not depth:
                    break
            pos += 1
        while True:
            m = _ATTRIBUTE.match(text, pos)
            pos = m.end()
            if m["close"]:
                return pos, TEMPLATE + "".join(holes)
            if m["open"]:
                break
            if m["brace"]:
                pos = hole(pos - 1)
            elif m["value"]:
                pos = element(pos) if text.startswith("<", pos) else hole(pos) if text.startswith("{", pos) else None
            elif not m["name"]:
                return None
            if pos is None:
                return None
        while True:
            pos = _CHILD_TEXT.match(text, pos).end()
            if m := _CLOSING.match(text, pos):
                return (m.end(), TEMPLATE + "".join(holes)) if m[1] == name else None
            pos = hole(pos) if text.startswith("{", pos) else element(pos)
            if pos is None:
                return None

    def _laid_out(self, text: str, raw: str, got: list | None) -> str:
        edits = self.edits(raw)
        self.last = (text, raw, edits, got)
        return apply(raw, edits) + EOF

    def edits(self, raw: str) -> list[tuple[int, int, str]]:
        """What layout replaces: (start, end, kinds)."""
        lang, out = self.language, []
        if lang in ("rust", "csharp"):
            return out
        if lang == "python":
            depth, stack, end = 0, [0], len(raw)
            for m in _LAYOUT.finditer(raw):
                c, at, to = raw[m.start()], m.start(), m.end()
                if c in "([{":
                    depth += 1
                elif c in ")]}":
                    depth -= depth > 0
                elif depth:
                    out.append((at, to, ""))
                else:
                    width = ord(raw[to - 1]) - ord(_NL0) if to < end else 0
                    add = "n" if at else ""
                    if width > stack[-1]:
                        stack.append(width)
                        add += INDENT
                    while width < stack[-1]:
                        stack.pop()
                        add += DEDENT
                        if width > stack[-1]:
                            add += BAD
                            break
                    out.append((at, to, add))
            if depth == 0 and raw and not _NL0 <= raw[-1] <= _NL1:
                out.append((end, end, "n" + DEDENT * (len(stack) - 1)))
            elif depth:
                out.append((end, end, DEDENT * (len(stack) - 1)))
            return out
        for m in _NEWLINES.finditer(raw):
            at, to = m.span()
            before, after = raw[at - 1] if at else NEWLINE, raw[to] if to < len(raw) else EOF
            if lang == "go":
                out.append((at, to, ";" if before in self.ends else ""))
            else:
                out.append((at, to, "" if before in self.open_end or after in self.carry or after == EOF else SOFT))
        if lang == "go" and raw and raw[-1] in self.ends:
            out.append((len(raw), len(raw), ";"))
        return out

    def place(self, text: str, at: int) -> tuple[int, int, str]:
        """Line (1-based), column (0-based) and token at position ``at`` of the kinds."""
        if self.last[0] is not text:
            self.scan(text)
        shift = 0
        for a, b, add in self.last[2]:
            if a + shift + len(add) > at:
                at = min(at, a + shift)
                break
            shift += len(add) - (b - a)
        at -= shift
        text, seen = clean(text, self.language), 0
        for start, token, kinds in self.last[3] or ((m.start(1), m[1], self.cache[m[1]]) for m in self.pattern.finditer(text)):
            seen += len(kinds)
            if seen > at:
                # a line break fails where the next line begins
                start += 0 if token.strip() else len(token)
                return text.count("\n", 0, start) + (self.language != "python"), start - text.rfind("\n", 0, start) - 1, token
        return text.count("\n") + (self.language != "python"), 0, ""


_ELEMENT = re.compile(r"<\s*([A-Za-z_$][\w$.:-]*|(?=>))")
_ATTRIBUTE = re.compile(r"""(?:\s|/\*[\s\S]*?\*/)*(?:(?P<close>/\s*>)|(?P<open>>)|(?P<brace>\{)|(?P<name>[A-Za-z_$][\w$:-]*)(?:\s*=\s*(?:"[^"]*"|'[^']*'|(?P<value>(?=[{<]))))?)?""")
_CHILD_TEXT = re.compile(r"[^<{}>]*")
_CLOSING = re.compile(r"</\s*([\w$.:-]*)\s*>")

_STRING = re.compile(r"([A-Za-z$@]*)(\"{3,}|'{3}|\"|')")
#: What matters inside the expression of a hole: brackets, strings, and what may end it.
_HOLE_PART = re.compile(r"""(?P<open>[(\[{])|(?P<close>[)\]}])|"{3}[\s\S]*?"{3}|'{3}[\s\S]*?'{3}|"(?:[^"\\]|\\[\s\S])*"|'(?:[^'\\]|\\[\s\S])*'|(?P<end>!(?!=)|:)""")
_BRACE = re.compile(r"\{+|\}+|\\")
_CONVERSION = re.compile(r"!\s*[rsa]\s*(?=[:}])")


class _Holes:
    """The holes of an interpolated string: ``kinds`` is null where they are not well formed."""

    def __init__(self, scanner: Scanner, body: str, width: int, raw: bool):
        self.scanner, self.body, self.width, self.raw = scanner, body, width, raw
        self.python = scanner.language == "python"
        self.out: list[str] = []
        #: where the expressions stand in the body
        self.spans: list[tuple[int, int]] = []

    def kinds(self) -> str | None:
        return "".join(self.out) if self._text(0, False) == len(self.body) else None

    def _text(self, i: int, spec: bool) -> int | None:
        """Read text (or a format, up to its closing brace) from ``i``; the place behind it."""
        body, w = self.body, self.width
        while m := _BRACE.search(body, i):
            i, run, c = m.start(), len(m[0]), m[0][0]
            if c == "\\":
                if self.raw:
                    i += 1
                elif self.python and body.startswith("\\N{", i) and (end := body.find("}", i)) > 0:
                    i = end + 1
                else:
                    i += 1 if body[i + 1 : i + 2] in ("{", "}") and self.python else 2
                continue
            if spec and c == "}":
                return i
            if w > 1:  # fewer braces than the literal asks for are text, more begin with text
                if run < w:
                    i += run
                    continue
                if c == "}":
                    return None
                i += run - w
            elif body.startswith(c * 2, i) and not spec:
                i += 2
                continue
            elif c == "}" or spec and not self.python:
                return None
            i = self._hole(i + w)
            if i is None:
                return None
        return None if spec else len(body)

    def _hole(self, i: int) -> int | None:
        """Read an expression from ``i`` and what follows it; the place behind the closing brace."""
        body, at, depth = self.body, i, 0
        while m := _HOLE_PART.search(body, at):
            at = m.end()
            if m["open"]:
                depth += 1
            elif m["close"] and depth:
                depth -= 1
            elif m["close"] or m["end"] and not depth:
                if not self.python and m["end"] and (m[0] == "!" or body[at : at + 1] == ":" or body[at - 2 : at] == "::"):
                    continue
                break
        else:
            return None
        end = m.start()
        self.spans.append((i, end))
        self.out.append(HOLE + self.scanner.inside(body[i:end]) + HOLE_END)
        if m[0] == "!":
            conv = _CONVERSION.match(body, end)
            if conv is None:
                return None
            end = conv.end()
        if body[end] == ":":
            end = self._text(end + 1, True)
            if end is None:
                return None
        return end + self.width if body.startswith("}" * self.width, end) else None


def _is_regex(t: str) -> bool:
    """Whether the groups of a regular expression close and its flags are known, each once."""
    body, _, flags = t[1:].rpartition("/")
    depth = 0
    for m in re.finditer(r"\\.|\[(?:[^\]\\]|\\.)*\]|[()]", body, re.S):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if depth < 0:
            return False
    return depth == 0 and len(set(flags)) == len(flags) and set(flags) <= set("dgimsuvy") and not {"u", "v"} <= set(flags)


@dataclass
class _Open:
    """A literal not yet closed: its place, what goes on with its text, braces that close a hole."""

    start: int
    chunk: re.Pattern
    width: int
    line: bool
    spec: bool = False
    hole: bool = False
    #: brackets open in the hole: of the kind that closes it, and of all kinds
    own: int = 0
    all: int = 0
    kinds: list[str] = field(default_factory=list)


@lru_cache(maxsize=256)
def _chunk(language: str, opener: str) -> str:
    """The text of a literal up to its end (group 1) or to its next hole."""
    if language == "python":
        q = opener.lstrip("fFrR")
        c, raw = q[0], "r" in opener.lower()
        named = "" if raw else r"\\N\{[^{}]*\}|"
        body = rf"[^{c}\\{{]|{c}(?!{c}{c})" if len(q) == 3 else rf"[^{c}\\\n{{]"
        return rf"(?:{named}{body}|\\[^{{]|\\(?=\{{)|\{{\{{)*+(?:({q})|\{{)"
    if language == "rust":
        return rf"[\s\S]*?(\"{opener.lstrip('bcr')[:-1]})"
    if language == "swift":
        h = opener.rstrip('"')
        q = opener[len(h) :]
        body = rf'[^"\\]|"(?!""{h})|\\{h}[^(]' if len(q) == 3 else rf'[^"\\\n]|\\{h}[^(\n]' + (f'|"(?!{h})' if h else "")
        return rf'(?:{body}' + (rf"|\\(?!{h})" if h else "") + rf')*+(?:({q}{h})|\\{h}\()'
    if language == "csharp":
        d, q = opener.count("$"), opener.count('"')
        if q >= 3:
            quotes = rf'(?<!")"{{1,{q - 1}}}(?!")'
            if not d:
                return rf'(?:[^"]|{quotes})*+("{{{q},}}(?:u8)?)'
            return rf'(?:[^"{{]|{quotes}|\{{(?=\{{{{{d}}})|\{{(?!\{{{{{d - 1}}}))*+(?:("{{{q},}})|\{{{{{d}}})'
        if "@" in opener:
            return r'(?:[^"{]|""|\{\{)*+(?:("(?!"))|\{)'
        return r'(?:[^"\\\n{]|\\[^\n]|\{\{)*+(?:(")|\{)'
    return r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(?:(`)|\$\{)"


_COMMENT = re.compile(r"/\*|\*/")


def _comment_ends(text: str, at: int) -> dict[int, int | None]:
    """The ends of the comment that opens at ``at`` and of those in it, null where there is none."""
    ends: dict[int, int | None] = {}
    stack: list[int] = []
    for m in _COMMENT.finditer(text, at):
        if m[0] == "/*":
            stack.append(m.start())
            ends[m.start()] = None
        else:
            ends[stack.pop()] = m.end()
            if not stack:
                break
    return ends


class _Cache(dict):
    """Kinds by token text, cleared when it has grown large."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, t: str) -> str:
        if len(self) > 100_000:
            self.clear()
        k = self.make(t)
        if len(t) < 80:
            self[t] = k
        return k


_LAYOUT = re.compile(f"[()\\[\\]{{}}]|[{_NL0}-{_NL1}]+")
_NEWLINES = re.compile("n+")


def clean(text: str, language: str) -> str:
    """Unix line ends; no byte order mark; no shebang where a language allows one."""
    if text.startswith("\ufeff"):
        text = text[1:]
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("#!") and language in ("javascript", "typescript", "swift", "rust") and not text.startswith("#!["):
        text = "//" + text
    return "\n" + text if language == "python" else text


def apply(raw: str, edits: list[tuple[int, int, str]]) -> str:
    parts, last = [], 0
    for a, b, add in edits:
        parts += (raw[last:a], add)
        last = b
    parts.append(raw[last:])
    return "".join(parts)


_BRACKETS = re.compile(f"[{re.escape(OPENERS + CLOSERS)}]")


def brackets(kinds: str) -> dict[int, int]:
    """Opener -> its closer; unmatched openers are absent."""
    pair = dict(zip(OPENERS, CLOSERS, strict=True))
    stack, out = [], {}
    for m in _BRACKETS.finditer(kinds):
        c = m[0]
        if c in pair:
            stack.append((m.start(), pair[c]))
        elif stack and stack[-1][1] == c:
            out[stack.pop()[0]] = m.start()
        else:
            break  # nothing after a wrong closer can match
    return out


@lru_cache(maxsize=16)
def scanner(language: str, strict: bool = False) -> Scanner:
    return Scanner(language, strict)
