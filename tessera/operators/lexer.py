"""Definitions, calls, type names and heritage of languages with braces, from tokens and matching brackets.

Text is cut into tokens, with comments, strings and directives over any number of lines left out. Brackets are matched
once; a declaration is then a keyword or a name with what follows it, up to its body or its end, wherever its lines break.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from tessera.functions.text import BUILTIN_NAMES

#: what, kind, name, first and last line, enclosing definition (of impl: the type), signature, qualifier.
Row = tuple[str, str, str | None, int, int, str | None, str | None, str | None]


class Token(NamedTuple):
    text: str
    line: int
    at: int
    word: bool


def _pattern(*skipped: str) -> re.Pattern[str]:
    return re.compile("|".join([f"(?P<skip>{'|'.join(skipped)})", r"(?P<word>[A-Za-z_$\u0080-\uffff][\w$]*)", r"(?P<other>::|->|=>|\d[\w.]*|[^\s\w])"]), re.S)


_COMMENTS = (r"//[^\n]*", r"/\*.*?(?:\*/|\Z)")
_STRING, _CHAR = r'"(?:\\.|[^"\\])*(?:"|\Z)', r"'(?:\\.|[^'\\\n])*'"
_DIRECTIVE = r"(?m:^[ \t]*\#(?:\\\r?\n|[^\n])*)"
_C = _pattern(*_COMMENTS, r'\bu?8?R"(?P<mark>[^(\s]*)\(.*?\)(?P=mark)"', _DIRECTIVE, _STRING, _CHAR)
TOKENS = {
    "rust": _pattern(*_COMMENTS, r'\bb?r(?P<mark>\#*)".*?"(?P=mark)', r"'(?:\\[^\n]+?|[^'\\\n])'", r"'\w+\b", _STRING),
    "javascript": _pattern(*_COMMENTS, r"`(?:\\.|[^`\\])*`", r"(?<=[=(,:;!&|?{}\[\n])\s*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*", _STRING, _CHAR),
    "go": _pattern(*_COMMENTS, r"`[^`]*`", _STRING, _CHAR),
    "java": _pattern(*_COMMENTS, r'""".*?"""', _STRING, _CHAR),
    "csharp": _pattern(*_COMMENTS, r'""".*?"""', r'\$?@\$?"(?:""|[^"])*"', _DIRECTIVE, r"\$?" + _STRING, _CHAR),
    "c": _C,
    "cpp": _C,
}
TOKENS["typescript"] = TOKENS["tsx"] = TOKENS["javascript"]

_PAIRS = {"(": ")", "[": "]", "{": "}"}
#: Words before which, or as which, an opening parenthesis makes no call and no method.
_CONTROL = set("if for while switch return catch match when lock using foreach fixed sizeof typeof alignof decltype static_assert await else do throw case in of yield and or not delete new function func fn def where as is goto pub synchronized assert defer go select super this extends implements default".split())
#: Words after which a name with a parenthesis is a call all the same.
_BEFORE_CALL = set("return else throw await case in of yield and or not do go defer when co_await co_return co_yield typeof".split())
_TYPES = {
    "java": {"class": "class", "interface": "trait", "enum": "enum", "record": "class"},
    "csharp": {"class": "class", "interface": "trait", "enum": "enum", "record": "class", "struct": "struct"},
    "cpp": {"class": "class", "struct": "struct", "enum": "enum"},
    "c": {"struct": "struct", "enum": "enum", "union": "struct"},
    "javascript": {"class": "class"},
    "typescript": {"class": "class"},
    "tsx": {"class": "class"},
    "rust": {"struct": "struct", "enum": "enum", "trait": "trait", "type": "type_alias"},
    "go": {},
}
_MODIFIERS = set("pub async unsafe const extern default export static abstract declare crate super final sealed partial public private protected internal".split())
_DECLARATORS = {"java", "csharp", "c", "cpp"}
LANGUAGES = set(TOKENS)


def kept(name: str | None) -> bool:
    return bool(name) and len(name.encode()) > 1 and name not in BUILTIN_NAMES


class _File:
    def __init__(self, text: str, language: str):
        self.text, self.language, self.types = text, language, _TYPES[language]
        self.tokens: list[Token] = []
        line = at = 0
        for m in TOKENS[language].finditer(text):
            line, at = line + text.count("\n", at, m.start()), m.start()
            if m.lastgroup != "skip" and m["skip"] is None:
                self.tokens.append(Token(m[0], line + 1, m.start(), m["word"] is not None))
        self.close = self._matched()
        self.out: list[Row] = []
        #: Of definitions and blocks: first and last token, name, kind.
        self.spans: list[tuple[int, int, str, str]] = []
        self.own_names: set[int] = set()

    def _matched(self) -> dict[int, int]:
        """Opening brackets and their closing ones; a wrong one closes nothing, an open one ends with the text."""
        out, stack = {}, []
        for i, t in enumerate(self.tokens):
            if t.text in _PAIRS:
                stack.append(i)
            elif t.text in (")", "]", "}") and any(_PAIRS[self.tokens[k].text] == t.text for k in stack):
                while _PAIRS[self.tokens[stack[-1]].text] != t.text:
                    out[stack.pop()] = i
                out[stack.pop()] = i
        return out | {i: len(self.tokens) - 1 for i in stack}

    def word(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) and self.tokens[i].word else ""

    def sign(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def after_angles(self, i: int) -> int:
        """The place behind the type arguments that begin at i (i itself where none do)."""
        if self.sign(i) != "<":
            return i
        depth = 0
        for j in range(i, min(i + 200, len(self.tokens))):
            s = self.sign(j)
            depth += (s == "<") - (s == ">")
            if depth == 0:
                return j + 1
            if s in (";", "{", "}"):
                break
        return i

    def body(self, i: int, stops: str = ";}") -> tuple[int | None, int]:
        """(opening brace of the body or None, last token) of a declaration that goes on at i."""
        while i < len(self.tokens):
            s = self.sign(i)
            if s == "{":
                return i, self.close[i]
            if s in stops:
                return None, i if s == ";" else i - 1
            i = self.close[i] + 1 if s in ("(", "[") else i + 1
        return None, len(self.tokens) - 1

    def begin(self, i: int) -> int:
        """The first token of the declaration that i is part of."""
        if self.language in _DECLARATORS:
            while i > 0 and self.sign(i - 1) not in (";", "{", "}", ":", "#"):
                i -= 1
            return i
        while self.word(i - 1) in _MODIFIERS or self.sign(i - 1) == ")" and self.word(i - 3) in ("(", "crate", "super") or self.sign(i - 1) == "(" and self.word(i - 2) == "pub":
            i -= 1
            if self.sign(i) == ")":
                i -= 2
        return i

    def define(self, kind: str, at: int, name: int, last: int, opened: int | None) -> None:
        first, end = self.tokens[self.begin(at)], self.tokens[min(last, len(self.tokens) - 1)]
        signature = self.text[first.at : self.text.find("\n", first.at) if "\n" in self.text[first.at :] else None].strip()
        owner = self.within(at)
        self.out.append(("def", kind, self.sign(name), first.line, end.line, owner[2] if owner else None, signature, None))
        self.own_names.add(name)
        if opened is not None or kind not in ("type_alias",):
            self.spans.append((self.begin(at), last, self.sign(name), kind))

    def within(self, i: int) -> tuple[int, int, str, str] | None:
        """The innermost definition or block around a token."""
        return next((s for s in reversed(self.spans) if s[0] <= i <= s[1]), None)

    def inside(self, i: int, kinds: set[str]) -> bool:
        return any(s[0] <= i <= s[1] and s[3] in kinds for s in self.spans)

    def names(self, i: int, end: int) -> list[str]:
        """Type names between two tokens: the last part of each path, without type arguments."""
        found, last = [], ""
        while i < end:
            s = self.sign(i)
            if s == "<":
                i = max(self.after_angles(i), i + 1)
                continue
            if s == "(":
                i = self.close[i] + 1
                continue
            if s == ",":
                found, last = [*found, last], ""
            elif self.word(i) and s not in ("public", "private", "protected", "virtual", "extends", "implements", "where", "dyn", "mut", "const"):
                last = s
            i += 1
        return [n for n in [*found, last] if n]

    def heritage(self, name: int, opened: int, last: int) -> None:
        """Rows of a type's bases, between its name and its body."""
        begin, end = self.after_angles(name + 1), opened
        words = [(i, self.word(i)) for i in range(begin, end)]
        if self.language in ("cpp", "csharp"):
            colon = next((i for i in range(begin, end) if self.sign(i) == ":"), None)
            stop = next((i for i, w in words if w == "where"), end)
            bases = self.names(colon + 1, stop) if colon is not None else []
        elif self.language == "java":
            at = [i for i, w in words if w in ("extends", "implements")] + [end]
            bases = [n for i, j in zip(at, at[1:], strict=False) for n in self.names(i + 1, j)]
        else:
            at = next((i for i, w in words if w == "extends"), None) or next((i for i, w in words if w == "implements"), None)
            stop = next((i for i, w in words if at and i > at and w == "implements"), end)
            bases = self.names(at + 1, stop)[:1] if at else []
        own = self.sign(name)
        for base in bases:
            if kept(base) and base != own:
                self.out.append(("impl", "implements", base, self.tokens[self.begin(name)].line, self.tokens[last].line, own, None, None))

    def type_at(self, i: int) -> None:
        """A type that a keyword at i declares."""
        kind, name = self.types[self.sign(i)], i + 1
        while self.word(name) in ("class", "struct") or self.sign(name) == "[":
            name = self.close[name] + 1 if self.sign(name) == "[" else name + 1
        if not self.word(name) or self.word(name) in ("where", "extends", "implements") or self.sign(i - 1) in (".", ":", ",", "::") and self.language != "rust":
            return
        if self.language == "rust":
            opened, last = self.body(self.after_angles(name + 1))
            if kind == "type_alias" and self.sign(i - 1) == "." or self.sign(name + 1) not in ("{", "(", ";", "<", "=", ":", "where"):
                return
        else:
            opened, last = self.body(name + 1, ";},)=" if self.language in ("c", "cpp") and self.sign(name + 1) not in (":", "final") else ";}")
            alone = self.sign(name + 1) == ";"
            if opened is None and not (alone and self.language in ("c", "cpp", "java", "csharp") or self.sign(self.close.get(name + 1, -9) + 1) == ";"):
                return
            if opened is not None and self.language in ("c", "cpp") and self.sign(name + 1) not in ("{", ":", "final"):
                return  # a function that returns it, or a variable
        self.own_names.update(range(i, name))
        self.define(kind, i, name, last, opened)
        if opened is not None and self.language not in ("rust", "c") and not (self.language == "java" and self.sign(i) == "interface"):
            self.heritage(name, opened, last)
        if self.language == "rust" and kind == "enum" and opened is not None:
            j = opened + 1
            while j < last:
                while self.sign(j) == "#":
                    j = self.close.get(j + 1, j) + 1
                if self.word(j):
                    end = j + 1
                    while end < last and self.sign(end) != ",":
                        end = self.close[end] + 1 if self.sign(end) in _PAIRS else end + 1
                    self.define("struct", j, j, end - 1, None)
                    j = end
                j += 1

    def impl_at(self, i: int) -> None:
        """A Rust impl block."""
        opened, last = self.body(i + 1)
        if opened is None or self.sign(i - 1) in ("(", ",", ":", "->", "<", "&", "=", "+"):
            return
        begin = self.after_angles(i + 1)
        stop = next((j for j in range(begin, opened) if self.word(j) == "where"), opened)
        split = next((j for j in range(begin, stop) if self.word(j) == "for"), None)
        of = self.names(begin if split is None else split + 1, stop)
        trait = self.names(begin, split)[-1:] if split is not None else []
        if of and of[-1] not in BUILTIN_NAMES:
            self.out.append(("impl", "implements", trait[0] if trait and trait[0] not in BUILTIN_NAMES else None, self.tokens[i].line, self.tokens[last].line, of[-1], None, None))
            self.spans.append((i, last, of[-1], "impl"))

    def function_at(self, i: int) -> None:
        """A function that a keyword (fn, func, function) at i declares."""
        name = i + 1 + (self.sign(i + 1) == "*")
        is_method = False
        if self.language == "go" and self.sign(name) == "(":
            name, is_method = self.close[name] + 1, True
        opened, last = self.body(self.after_angles(name + 1))
        if self.word(name) and (opened is not None or self.language == "go"):
            kind = "method" if is_method or self.language == "rust" and self.inside(i, {"impl"}) else "function"
            self.define(kind, i, name, last, opened)

    def go_types(self, i: int) -> None:
        spots = [i + 1] if self.word(i + 1) else []
        if self.sign(i + 1) == "(":
            spots = [j for j in range(i + 2, self.close[i + 1]) if self.word(j) and self.tokens[j].line != self.tokens[j - 1].line]
        for j in spots:
            k = self.close[j + 1] + 1 if self.sign(j + 1) == "[" else j + 1
            if self.word(k) == "struct" and self.sign(k + 1) == "{":
                self.define("struct", j if len(spots) > 1 else i, j, self.close[k + 1], k + 1)

    def declared_at(self, i: int) -> bool:
        """A method or function by its name at i and the parenthesis behind it; whether it is one."""
        opening = self.after_angles(i + 1)
        if self.sign(opening) != "(" or self.word(i) in _CONTROL:
            return False
        end = self.close[opening] + 1
        before, owner = self.sign(i - 1), self.within(i)
        in_type = owner is not None and owner[3] in ("class", "struct", "trait", "enum")
        if self.language in ("javascript", "typescript", "tsx"):
            opened, last = self.body(end, ";},)=")
            plain = self.sign(end) == "{" or self.sign(end) == ":" and opened is not None and in_type
            if in_type and not plain and (before in ("{", "}", ";") or self.word(i - 1) in _MODIFIERS):
                return True  # a signature without a body
            if not plain or before in (".", "new", "function", "=>") or self.word(i - 1) in ("function", "new"):
                return False
            self.define("method", i, i, last, opened)
            return True
        if owner is not None and not in_type:
            return False  # inside a function
        qualified = before == "::" and self.language == "cpp"
        left = self.sign(i - 3) if qualified else before
        typed = left in (">", "]", "?", "*", "&") or bool(re.match(r"[A-Za-z_$\u0080-\uffff]", left)) and left not in _CONTROL
        constructor = in_type and (self.sign(i) == owner[2] and left in ("{", "}", ";", ":", "", ")") or self.word(i - 1) in _MODIFIERS | {"explicit", "inline"}) or qualified and self.sign(i - 2) == self.sign(i)
        if not (typed or constructor) or self.language in ("java", "csharp") and not in_type:
            return False
        arrow = self.sign(end) == "=>" and self.language == "csharp"
        opened, last = self.body(end, ";}" if not arrow else ";")
        tail = [self.sign(j) for j in range(end, opened if opened is not None else last)]
        if not arrow and any(s in ("=", ",", "(") and s != tail[0] for s in tail[:1]):
            return False
        if self.language in ("c", "cpp") and self.sign(end) not in ("{", ";", ":", "->", "=") and not self.word(end):
            return False
        kind = "method" if in_type or qualified else "function"
        self.define("method" if self.language in ("java", "csharp") else kind, i, i, last, opened)
        return True

    def alias_at(self, i: int) -> None:
        opened, last = self.body(i + 1, ";")
        if opened is not None:
            last = next((j for j in range(self.close[opened], len(self.tokens)) if self.sign(j) == ";"), last)
        name = i + 1 if self.word(i) == "using" else last - 1
        if self.word(name) and (self.word(i) == "typedef" or self.sign(i + 2) == "="):
            self.out.append(("def", "type_alias", self.sign(name), self.tokens[i].line, self.tokens[last].line, None, self.text[self.tokens[i].at :].split("\n", 1)[0].strip(), None))
            self.own_names.add(name)

    def reference_at(self, i: int) -> None:
        """A call or a type name at i."""
        name, end = self.word(i), i + 1
        if self.language == "rust" and self.sign(end) == "::" and self.sign(end + 1) == "<":
            end = self.after_angles(end + 1)
        elif self.language in ("typescript", "tsx", "csharp", "cpp") and self.sign(self.after_angles(end)) == "(":
            end = self.after_angles(end)
        before, line, owner = self.sign(i - 1), self.tokens[i].line, self.within(i)
        place = owner[2] if owner else None
        if owner and owner[3] == "enum" and self.language == "java" and before in ("{", ","):
            return  # a constant
        if self.sign(end) == "(" and (name not in _CONTROL or before in (".", "::", "->")) and before != "@":
            created = self.word(i - 1) == "new"
            declared = self.language in _DECLARATORS and (self.word(i - 1) and self.word(i - 1) not in _BEFORE_CALL or before == ">" and self.language in ("c", "cpp"))
            if not created and not declared:
                of = self.word(i - 2) if before in (".", "::", "->") and self.language != "go" else ""
                self.out.append(("ref", "calls", name, line, line, place, None, of if of[:1].isupper() and kept(of) else None))
                return
            if not created:
                return
        if self.language in ("javascript", "go") or not name[:1].isupper() or not kept(name) or re.fullmatch(r"[A-Z0-9_]*_[A-Z0-9_]*", name):
            return
        scope = {"java": ".", "typescript": ".", "tsx": ".", "csharp": ".", "cpp": "::"}.get(self.language)
        if before == "." or scope and self.sign(i + 1) == scope or self.language == "rust" and before == "::" and self.sign(end) not in ("{", "<", "::", ">", ",", ")", ";", "&"):
            return
        self.out.append(("ref", "references", name, line, line, place, None, None))

    def rows(self) -> list[Row]:
        i, n = 0, len(self.tokens)
        while i < n:
            w = self.word(i)
            if self.sign(i) == "#" and self.language == "rust" and self.sign(i + 1 + (self.sign(i + 1) == "!")) == "[":
                i = self.close[i + 1 + (self.sign(i + 1) == "!")] + 1  # an attribute
                continue
            if w in self.types and i not in self.own_names and (w != "record" or self.word(i + 1)):
                self.type_at(i)
            elif w == "impl" and self.language == "rust":
                self.impl_at(i)
            elif w == "func" and self.language == "go" and (self.within(i) or i and self.tokens[i - 1].line == self.tokens[i].line):
                pass  # a type or a value
            elif w in ("fn", "func", "function") and w == {"rust": "fn", "go": "func"}.get(self.language, "function"):
                self.function_at(i)
            elif w == "type" and self.language == "go":
                self.go_types(i)
            elif w == "interface" and self.language == "go" and self.sign(i + 1) == "{":
                i = self.close[i + 1]
            elif w in ("typedef", "using") and self.language in ("c", "cpp"):
                self.alias_at(i)
            elif w and i not in self.own_names and not (self.language not in ("rust", "go") and self.declared_at(i)):
                self.reference_at(i)
            i += 1
        return self.out


def rows(text: str, language: str) -> list[Row]:
    return _File(text, language).rows()
