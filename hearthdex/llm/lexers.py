"""Token streams of the languages with a bundled grammar.

A lexer gives kinds (what the grammar calls tokens), places, and whether a line ends before
a token; what is no token of the language has the kind BAD and ends the stream.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Tokens:
    kinds: list[str] = field(default_factory=list)
    places: list[int] = field(default_factory=list)
    before: list[bool] = field(default_factory=list)

    def add(self, kind: str, place: int, before: bool = False) -> None:
        self.kinds.append(kind)
        self.places.append(place)
        self.before.append(before)


class Broken(Exception):
    """Text that is no token; ``place`` is where."""

    def __init__(self, place: int):
        self.place = place


# Python -------------------------------------------------------------------------------

PYTHON_KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is "
    "lambda nonlocal not or pass raise return try while with yield".split()
)
_PY_OPERATORS = {
    **dict.fromkeys(("<", ">", "==", ">=", "<=", "!="), "COMPARE"),
    **dict.fromkeys(("//", "%", "<<", ">>", "&", "^"), "OPERATOR"),
    **dict.fromkeys(("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="), "AUGMENT"),
}
_PY_NUMBER = r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?"
_PY = re.compile(
    r"(?P<space>[ \t\f]+|\\(?:\r\n|\n|\r))"
    r"|(?P<line>\r\n|\n|\r)"
    r"|(?P<comment>#[^\r\n]*)"
    r"|(?P<fstr>(?:[fF][rR]?|[rR][fF])(?:\"\"\"|'''|\"|'))"
    r"|(?P<str>(?:[uUbB]|[bB][rR]|[rR][bB]?)?(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|\"(?!\"\")(?:[^\"\\\r\n]|\\(?:\r\n|.))*\"|'(?!'')(?:[^'\\\r\n]|\\(?:\r\n|.))*'))"
    r"|(?P<name>[^\W\d]\w*)"
    rf"|(?P<number>{_PY_NUMBER})"
    r"|(?P<op>\.\.\.|->|:=|\*\*=|//=|>>=|<<=|[+\-*/%@&|^=<>!]=|\*\*|//|<<|>>|[+\-*/%@&|^~=<>()\[\]{},:.;!])",
    re.S,
)
_PY_BAD_ESCAPE = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!000[0-9a-fA-F]{5}|0010[0-9a-fA-F]{4})|N(?!\{[^}]+\}))")
_PY_BLANK = re.compile(r"(?:[ \t\f]*(?:#[^\r\n]*)?(?:\r\n|\n|\r))*[ \t\f]*(?:#[^\r\n]*\Z)?")
_BEFORE_NUMBER_END = re.compile(r"(?:and|else|for|if|in|is|not|or)\b")


def _py_fstring(text: str, at: int, opener: str, out: Tokens) -> int:
    """Tokens of an f-string whose quotes open before ``at``; the place behind it."""
    quote = opener.lstrip("fFrR")
    raw = "r" in opener.lower()
    return _py_fparts(text, at, quote, raw, out, False)


def _py_fparts(text: str, at: int, quote: str, raw: bool, out: Tokens, spec: bool) -> int:
    n = len(text)
    while at < n:
        c = text[at]
        if not spec and text.startswith(quote, at):
            out.add("FEND", at)
            return at + len(quote)
        if c == "\\" and not (raw and spec):
            if not raw and text.startswith("\\N{", at):
                close = text.find("}", at)
                if close < 0:
                    raise Broken(at)
                at = close + 1
                continue
            if not raw and _PY_BAD_ESCAPE.match(text, at):
                raise Broken(at)
            at += 1 if text[at + 1 : at + 2] in "{}" and at + 1 < n else 2
        elif c == "{":
            if text.startswith("{{", at) and not spec:
                at += 2
                continue
            out.add("FOPEN", at)
            at = _py_tokens(text, at + 1, out, (quote, raw))
        elif c == "}":
            if spec:
                return at
            if not text.startswith("}}", at):
                raise Broken(at)
            at += 2
        elif c in "\r\n" and len(quote) == 1:
            raise Broken(at)
        elif spec and text.startswith(quote, at):
            raise Broken(at)
        else:
            at += 1
    raise Broken(at)


def _py_tokens(text: str, at: int, out: Tokens, inside: tuple[str, bool] | None = None) -> int:
    """Tokens from ``at``: of a whole file, or of a replacement field up to and with its end."""
    kinds, places, before = out.kinds, out.places, out.before
    match, operators, keywords = _PY.match, _PY_OPERATORS, PYTHON_KEYWORDS
    depth, n = 0, len(text)
    opened: list[str] = []
    indents = [(0, 0)]
    start = inside is None
    while at < n:
        if start:
            start = False
            m = _PY_BLANK.match(text, at)
            lead = m.end()
            line = max(text.rfind("\n", at, lead), text.rfind("\r", at, lead)) + 1 or at
            at = lead
            if at >= n:
                break
            if text[at] not in "\\":
                white = text[line:at]
                col = alt = 0
                for c in white:
                    if c == "\t":
                        col, alt = (col // 8 + 1) * 8, alt + 1
                    elif c == "\f":
                        col = alt = 0
                    else:
                        col, alt = col + 1, alt + 1
                if (col, alt) != indents[-1]:
                    if col == indents[-1][0] or (col > indents[-1][0]) != (alt > indents[-1][1]) and col > indents[-1][0]:
                        raise Broken(at)
                    if col > indents[-1][0]:
                        indents.append((col, alt))
                        kinds.append("INDENT")
                        places.append(at)
                        before.append(True)
                    else:
                        while indents and indents[-1][0] > col:
                            indents.pop()
                            kinds.append("DEDENT")
                            places.append(at)
                            before.append(True)
                        if not indents or indents[-1] != (col, alt):
                            raise Broken(at)
        m = match(text, at)
        if m is None:
            raise Broken(at)
        kind = m.lastgroup
        end = m.end()
        if kind == "name":
            word = m[0]
            if word in keywords:
                kinds.append(word)
            else:
                if not word.isascii() and not word.isidentifier():
                    raise Broken(at)
                kinds.append("NAME")
            places.append(at)
            before.append(False)
        elif kind == "op":
            op = m[0]
            if op in "([{":
                opened.append(op)
                depth += 1
            elif op in ")]}":
                if inside is not None and not depth:
                    if op != "}":
                        raise Broken(at)
                    out.add("FCLOSE", at)
                    return end
                if not depth or opened.pop() + op not in ("()", "[]", "{}"):
                    raise Broken(at)
                depth -= 1
            elif inside is not None and not depth:
                if op == ":=" or op == ":":
                    out.add("FSPEC", at)
                    at = _py_fparts(text, at + 1, inside[0], inside[1], out, True)
                    out.add("FCLOSE", at)
                    return at + 1
                if op == "!=" and text[end : end + 1] == "=":
                    pass
            kinds.append(operators.get(op, op))
            places.append(at)
            before.append(False)
        elif kind == "space" or kind == "comment":
            pass
        elif kind == "str":
            word = m[0]
            prefix = word[: min(word.find('"') if '"' in word else 9, word.find("'") if "'" in word else 9)].lower()
            if "\\" in word and "r" not in prefix and _PY_BAD_ESCAPE.search(word.replace("\\\\", "..")):
                bad = _PY_BAD_ESCAPE.search(word.replace("\\\\", ".."))
                if "b" not in prefix or bad[0][1] == "x":
                    raise Broken(at)
            if "b" in prefix and not word.isascii():
                raise Broken(at)
            kinds.append("STRING")
            places.append(at)
            before.append(False)
        elif kind == "line":
            if not depth and inside is None:
                kinds.append("NEWLINE")
                places.append(at)
                before.append(False)
                start = True
        elif kind == "number":
            word = m[0]
            if word[0] == "0" and len(word) > 1 and word[1].isdigit() or word.startswith("0_"):
                if word.replace("_", "").strip("0") and not any(c in word for c in ".eEjJ"):
                    raise Broken(at)
            if end < n and (text[end].isalnum() or text[end] == "_") and not _BEFORE_NUMBER_END.match(text, end):
                raise Broken(at)
            kinds.append("NUMBER")
            places.append(at)
            before.append(False)
        else:
            out.add("FSTART", at)
            end = _py_fstring(text, end, m[0], out)
        at = end
    if inside is not None:
        raise Broken(n)
    if depth:
        raise Broken(n)
    if kinds and kinds[-1] not in ("NEWLINE", "DEDENT"):
        out.add("NEWLINE", n)
    for _ in indents[1:]:
        out.add("DEDENT", n)
    out.add("EOF", n)
    return n


def python_tokens(text: str) -> Tokens:
    out = Tokens()
    if text.startswith("\ufeff"):
        text = text[1:]
    try:
        if "\0" in text:
            raise Broken(text.index("\0"))
        _py_tokens(text, 0, out)
    except Broken as x:
        out.add("BAD", x.place, True)
        out.add("EOF", x.place)
    return out


# Rust ---------------------------------------------------------------------------------

RUST_KEYWORDS = frozenset(
    "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct "
    "super trait true type unsafe use where while async await dyn abstract become box do final macro override priv typeof unsized virtual "
    "yield try".split()
)
_RS = re.compile(
    r"(?P<space>\s+|//[^\n]*)"
    r"|(?P<comment>/\*)"
    r"|(?P<raw>(?:b|c)?r(?P<hashes>#*)\")"
    r"|(?P<rawname>r#[^\W\d]\w*)"
    r"|(?P<str>[bc]?\"(?:[^\"\\]|\\.)*\")"
    r"|(?P<char>b?'(?:[^'\\\n\r\t]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,10}\}|[nrt\\0'\"]))')"
    r"|(?P<life>'[^\W\d]\w*(?!'))"
    r"|(?P<name>[^\W\d]\w*)"
    r"|(?P<number>0[xob][0-9a-fA-F_]+\w*|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?_*\d[\d_]*)?\w*)"
    r"|(?P<op>\.\.\.|\.\.=|\.\.|::|->|=>|&&|\|\||[+\-*/%^&|!=<]=|[+\-*/%^&|!=<>@.,;:#$?~(){}\[\]_\\])",
    re.S,
)
_RS_ASSIGN = frozenset({"+=", "-=", "*=", "/=", "%=", "^=", "&=", "|="})
_RS_SUFFIX = re.compile(r"(?:[iu](?:8|16|32|64|128|size)|f(?:16|32|64|128))?\Z")
_RS_NUMBER = re.compile(r"0x[0-9a-fA-F_]*?(?=[iu](?:8|16|32|64|128|size)\Z|\Z)|0o[0-7_]*|0b[01_]*|\d[\d_]*(?:\.\d[\d_]*|\.)?(?:[eE][+-]?_*\d[\d_]*)?")
_RS_PAIR = {"(": ")", "[": "]", "{": "}"}


def rust_tokens(text: str) -> tuple[Tokens, list[int]]:
    """Tokens, and for each opening bracket the number of its closing one."""
    out = Tokens()
    kinds, places = out.kinds, out.places
    partner: list[int] = []
    stack: list[int] = []
    match, keywords = _RS.match, RUST_KEYWORDS
    at, n = 0, len(text)
    if text.startswith("﻿"):
        at = 1
    if text.startswith("#!", at) and not re.match(r"#!\s*\[", text[at : at + 40]):
        at = (text.find("\n", at) + 1) or n
    doc = False
    try:
        while at < n:
            m = match(text, at)
            if m is None:
                raise Broken(at)
            kind, end = m.lastgroup, m.end()
            if kind == "space":
                if text.startswith("///", at) and not text.startswith("////", at):
                    doc = True
                at = end
                continue
            if kind == "comment":
                depth, start = 1, at
                while depth:
                    a, b = text.find("/*", end), text.find("*/", end)
                    if b < 0:
                        raise Broken(start)
                    if 0 <= a < b:
                        depth, end = depth + 1, a + 2
                    else:
                        depth, end = depth - 1, b + 2
                doc = doc or (text.startswith("/**", start) and not text.startswith(("/***", "/**/"), start))
                at = end
                continue
            if text[at] in "<=>|" and (at == 0 or text[at - 1] == "\n") and _MARKER.match(text, at):
                raise Broken(at)  # the grammar skips what macros are given
            if kind == "name":
                word = m[0]
                if word == "_":
                    kind = "_"
                else:
                    kind = word if word in keywords else "IDENT"
            elif kind == "op":
                kind = m[0]
                if kind in _RS_ASSIGN:
                    kind = "ASSIGN"
                elif kind in _RS_PAIR:
                    stack.append(len(kinds))
                elif kind in ")]}":
                    if not stack or _RS_PAIR[kinds[stack[-1]]] != kind or (doc and kind == "}"):
                        raise Broken(at)
                    partner[stack.pop()] = len(kinds)
                elif kind == "\\":
                    raise Broken(at)
            elif kind == "number":
                word = m[0]
                if kinds and kinds[-1] == "." and "." in word:
                    # a field of a field: x.0.1
                    first = word.index(".")
                    end = at + (first or 1)
                    word = word[:first]
                body = _RS_NUMBER.match(word)
                if not body or not _RS_SUFFIX.match(word[body.end() :]) or not word.strip("_"):
                    raise Broken(at)
                kind = "NUM"
            elif kind in ("raw", "hashes"):
                close = text.find('"' + m["hashes"], end)
                if close < 0:
                    raise Broken(at)
                end, kind = close + 1 + len(m["hashes"]), "STR"
            elif kind == "str":
                kind = "STR"
            elif kind == "char":
                kind = "CHAR"
            elif kind == "life":
                kind = "LIFETIME"
            else:
                kind = "IDENT"
            doc = False
            kinds.append(kind)
            places.append(at)
            partner.append(-1)
            at = end
        if stack or doc:
            raise Broken(n if doc else n)
    except Broken as x:
        kinds.append("BAD")
        places.append(x.place)
        partner.append(-1)
    kinds.append("EOF")
    places.append(n)
    partner.append(-1)
    return out, partner


# JavaScript and TypeScript ------------------------------------------------------------

_JS_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in "
    "instanceof new null return super switch this throw true try typeof var void while with let static async await yield of get set as from "
    "type interface namespace module declare abstract readonly public private protected override is asserts infer keyof unique satisfies "
    "accessor global implements out require assert using".split()
)
#: Words after which a slash begins a regular expression and ``<`` an element.
_JS_OPERATOR_WORDS = frozenset("return typeof case do else in instanceof new void delete throw default await yield of extends".split())
_JS_NUMBER = r"0[xX][\da-fA-F](?:_?[\da-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:\d(?:_?\d)*)n|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?"
_JS = re.compile(
    r"(?P<space>[ \t\v\f ﻿]+)"
    r"|(?P<line>[\r\n  ]\s*)"
    r"|(?P<word>(?:[A-Za-z_$]|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\}|[^\W\d_])(?:[\w$‌‍]|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})*)"
    rf"|(?P<number>(?=[\d.])(?:{_JS_NUMBER})(?<![^\d]\.)(?<!^\.))"
    r"|(?P<str>\"(?:[^\"\\\r\n]|\\(?:\r\n|[^u]|u[\da-fA-F]{4}|u\{[\da-fA-F]+\}))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|[^u]|u[\da-fA-F]{4}|u\{[\da-fA-F]+\}))*')"
    r"|(?P<comment>//[^\r\n  ]*|/\*)"
    r"|(?P<private>\#(?:\$|[^\W\d])[\w$]*)"
    r"|(?P<op>\.\.\.|=>|===|!==|==|!=|\*\*=|\*\*|<<=|<<|<=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[+\-*%&|^]=|[+\-*%&|^!~<>=?:;,.(){}\[\]@])"
    r"|(?P<tick>`)"
    r"|(?P<slash>/)",
    re.S,
)
_JS_KIND = {
    **dict.fromkeys(("===", "!==", "==", "!=", "**", "<<", "<=", "&&", "||", "??", "%", "^", "/"), "BINARY"),
    **dict.fromkeys(("**=", "<<=", "&&=", "||=", "??=", "+=", "-=", "*=", "%=", "&=", "|=", "^=", "/="), "ASSIGN"),
}
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\\\]\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
_JS_LINE = re.compile(r"[^\r\n\u2028\u2029]*")
_JS_PAIR = {"(": ")", "[": "]", "{": "}"}
_JS_OPERAND_END = frozenset({"IDENT", "NUMBER", "STRING", "REGEX", "TEND", "JEND", "PRIVATE", ")", "]", "}", "++", "--"})
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$-]*(?::[A-Za-z_$][\w$-]*)?(?:\.[A-Za-z_$][\w$-]*)*")
_JSX_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)*", re.S)
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_JSX_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b(?!\s*=)|=[^>])")
_MARKER = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?:[ \r\n]|$)", re.M)


class _Ecma:
    def __init__(self, text: str, typed: bool, jsx: bool, regex_after: frozenset = frozenset(), html: bool = False):
        self.text, self.typed, self.jsx, self.html = text, typed, jsx, html
        self.out = Tokens()
        self.partner: list[int] = []
        self.ends = _JS_OPERAND_END - regex_after
        self.doubtful = False

    def add(self, kind: str, place: int, before: bool = False) -> None:
        self.out.add(kind, place, before)
        self.partner.append(-1)

    def operand_before(self) -> bool:
        kinds = self.out.kinds
        if not kinds:
            return False
        last = kinds[-1]
        if last in self.ends:
            return True
        return last in _JS_WORDS and last not in _JS_OPERATOR_WORDS

    def run(self) -> int:
        at = 1 if self.text.startswith("﻿") else 0
        if self.text.startswith("#!", at):
            m = re.compile(r"[^\r\n]*").match(self.text, at)
            at = m.end()
        at = self.tokens(at, "")
        self.add("EOF", at, True)
        return at

    def tokens(self, at: int, closer: str) -> int:
        """Up to the end, or behind the bracket that closes what ``closer`` names (TCLOSE, JCLOSE, JTEND)."""
        text, out, partner = self.text, self.out, self.partner
        kinds, places, before = out.kinds, out.places, out.before
        match, n = _JS.match, len(text)
        stack: list[int] = []
        line, angles = not kinds, 1
        while at < n:
            m = match(text, at)
            if m is None:
                if text[at].isspace():
                    at += 1
                    continue
                raise Broken(at)
            group, end = m.lastgroup, m.end()
            if group == "space":
                at = end
                continue
            if group == "line":
                line, at = True, end
                continue
            if group == "word":
                word = m[0]
                dotted = kinds and kinds[-1] in (".", "?.")
                kind = word if not dotted and word in _JS_WORDS else "IDENT"
            elif group == "op":
                word = m[0]
                kind = _JS_KIND.get(word, word)
                if closer == "JTEND" and word in ("<", ">") and not stack:
                    angles += 1 if word == "<" else -1
                    if not angles:
                        self.add(closer, at)
                        return end
                elif self.html and (text.startswith("<!--", at) or line and text.startswith("-->", at)):
                    at = _JS_LINE.match(text, at).end()
                    continue
                elif word == "<" or word == "<<":
                    if self.jsx and not self.operand_before() and word == "<" and self.element_at(at):
                        self.add("JSX", at, line)
                        line = False
                        at = self.element(at)
                        self.add("JEND", at)
                        continue
                    if word == "<<" and self.typed and kinds and kinds[-1] == "IDENT" and re.match(r"<<[A-Za-z_$][\w$]*>?\(", text[at : at + 40]):
                        kind, end = "<", at + 1
                elif word in _JS_PAIR:
                    stack.append(len(kinds))
                elif word in ")]}":
                    if not stack:
                        if word == "}" and closer and closer != "JTEND":
                            self.add(closer, at, line)
                            return end
                        raise Broken(at)
                    first = stack.pop()
                    if _JS_PAIR[kinds[first]] != word:
                        raise Broken(at)
                    partner[first] = len(kinds)
            elif group == "comment":
                if m[0] == "/*":
                    close = text.find("*/", end)
                    if close < 0:
                        raise Broken(at)
                    line = line or "\n" in text[at:close]
                    end = close + 2
                at = end
                continue
            elif group == "str":
                kind = "STRING"
            elif group == "number":
                kind = "NUMBER"
                if end < n and (text[end].isalnum() or text[end] in "_$"):
                    raise Broken(at)
            elif group == "private":
                kind = "PRIVATE"
            elif group == "tick":
                self.add("TSTART", at, line)
                line = False
                at = self.template(end)
                continue
            else:
                if kinds and kinds[-1] in (")", "}"):
                    self.doubtful = True
                r = None if self.operand_before() else _JS_REGEX.match(text, at)
                if r:
                    kind, end = "REGEX", r.end()
                elif text.startswith("/=", at):
                    kind, end = "ASSIGN", at + 2
                else:
                    kind = "BINARY"
            kinds.append(kind)
            places.append(at)
            before.append(line)
            partner.append(-1)
            line = False
            at = end
        if closer or stack:
            raise Broken(n)
        return n

    def template(self, at: int) -> int:
        text, n = self.text, len(self.text)
        while at < n:
            c = text[at]
            if c == "\\":
                at += 2
            elif c == "`":
                self.add("TEND", at)
                return at + 1
            elif c == "$" and text.startswith("${", at):
                self.add("TOPEN", at)
                at = self.tokens(at + 2, "TCLOSE")
            else:
                at += 1
        raise Broken(n)

    def element_at(self, at: int) -> bool:
        text = self.text
        if text.startswith("<>", at):
            return True
        m = _JSX_NAME.match(text, at + 1)
        if not m:
            return False
        if self.typed and _JSX_GENERIC.match(text, at):
            return False
        if self.typed and text.startswith(">(", m.end()) and f"</{m[0]}" not in text[m.end() :]:
            return False
        return True

    def element(self, at: int) -> int:
        """Checks an element from its ``<``; the place behind it. Expressions inside become tokens."""
        text, n = self.text, len(self.text)
        if text.startswith("<>", at):
            name, at = "", at + 2
        else:
            m = _JSX_NAME.match(text, at + 1)
            if not m:
                raise Broken(at)
            name, at = m[0], m.end()
            if self.typed and text.startswith("<", at):
                self.add("JTYPES", at)
                at = self.tokens(at + 1, "JTEND")
            while True:
                at = _JSX_SPACE.match(text, at).end()
                if at >= n:
                    raise Broken(n)
                c = text[at]
                if c == ">":
                    at += 1
                    break
                if c == "/":
                    if not text.startswith("/>", at):
                        raise Broken(at)
                    return at + 2
                if c == "{":
                    self.add("JOPEN", at)
                    at = self.tokens(at + 1, "JCLOSE")
                    continue
                m = _JSX_NAME.match(text, at)
                if not m or "." in m[0]:
                    raise Broken(at)
                at = _JSX_SPACE.match(text, m.end()).end()
                if text.startswith("=", at):
                    at = _JSX_SPACE.match(text, at + 1).end()
                    m = _JSX_STRING.match(text, at)
                    if m:
                        at = m.end()
                    elif text.startswith("{", at):
                        self.add("JOPEN", at)
                        at = self.tokens(at + 1, "JCLOSE")
                    elif text.startswith("<", at):
                        at = self.element(at)
                    else:
                        raise Broken(at)
        while at < n:
            c = text[at]
            if c == "{":
                self.add("JOPEN", at)
                at = self.tokens(at + 1, "JCLOSE")
            elif c == "<":
                if text.startswith("</", at):
                    at = _JSX_SPACE.match(text, at + 2).end()
                    m = _JSX_NAME.match(text, at)
                    if (m[0] if m else "") != name:
                        raise Broken(at)
                    at = _JSX_SPACE.match(text, m.end() if m else at).end()
                    if not text.startswith(">", at):
                        raise Broken(at)
                    return at + 1
                at = self.element(at)
            elif c in ">}":
                raise Broken(at)
            elif c in "=|" and _MARKER.match(text, at) and (at == 0 or text[at - 1] == "\n"):
                raise Broken(at)
            else:
                at += 1
        raise Broken(n)


def ecma_tokens(text: str, typed: bool, jsx: bool, regex_after: frozenset = frozenset(), html: bool = False) -> tuple[Tokens, list[int], bool]:
    """Tokens, partners of brackets, and whether a slash might have been read the other way; ``html`` allows ``<!--`` and ``-->``."""
    x = _Ecma(text, typed, jsx, regex_after, html)
    try:
        x.run()
    except Broken as e:
        x.add("BAD", e.place, True)
        x.add("EOF", len(text), True)
    return x.out, x.partner, x.doubtful
