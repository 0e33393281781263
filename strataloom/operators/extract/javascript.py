"""Structure of JavaScript, TypeScript and JSX files by a tokenizer and bracket matching, without a grammar."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from strataloom.operators.extract.generic import analysis, is_external

# Verbs and receivers of route registrations.
VERBS = frozenset("get post put patch delete options head all use".split())
_ROUTER = re.compile(r"(?i)^(app|router|server|api|route|_router)$")

_SPACE, _IDENT, _NUMBER = re.compile(r"\s+"), re.compile(r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*"), re.compile(r"\d[\w.]*")
_PUNCT = re.compile(r"=>|\.\.\.|\?\.(?!\d)|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|[^\s\w]")
_NOT_CALLS = frozenset("if for while switch catch function return typeof await new delete void in of instanceof case do else throw yield super with async".split())
_BEFORE_VALUE = frozenset("return typeof case do else in of instanceof new delete void throw yield await default".split())
_TYPE_PREFIX = frozenset("keyof typeof readonly infer unique extends".split())
_DEEPEST_TYPE = 16  # levels of type arguments within each other
_STATEMENT = frozenset("const let var function class export import return if for while switch try throw do async".split())


@dataclass
class Token:
    kind: str  # id, num, str, tmpl, re, jsx, or the punctuation itself
    value: str
    line: int
    comment: str | None = None  # the last comment before it
    mate: int = -1  # of a bracket: the index of its partner
    parent: int = -1  # index of the bracket around it
    parts: list[str] = field(default_factory=list)  # of a template: its literal parts


class Tokens(list):
    """Tokens of a file; ValueError where strings, comments or brackets don't close."""

    def __init__(self, code: str, jsx: bool = True):
        super().__init__()
        self.code, self.jsx, self.line, self.comment = code, jsx, 1, None
        self._scan(0, None)
        stack: list[int] = []
        for i, t in enumerate(self):
            t.parent = stack[-1] if stack else -1
            if t.kind in "([{" and len(t.kind) == 1:
                stack.append(i)
            elif t.kind in (")", "]", "}"):
                if not stack or "([{".index(self[stack[-1]].kind) != ")]}".index(t.kind):
                    raise ValueError(f"line {t.line}: unbalanced {t.kind}")
                t.mate = stack.pop()
                self[t.mate].mate, t.parent = i, self[t.mate].parent
        if stack:
            raise ValueError(f"line {self[stack[-1]].line}: {self[stack[-1]].kind} isn't closed")

    def _put(self, kind: str, value: str, parts: list[str] | None = None) -> None:
        self.append(Token(kind, value, self.line, self.comment, parts=parts or []))
        self.comment = None
        self.line += value.count("\n")

    def _expects_value(self) -> bool:
        if not self:
            return True
        last = self[-1]
        return last.kind not in ("num", "str", "tmpl", "re", "jsx", ")", "]", "}") and (last.kind != "id" or last.value in _BEFORE_VALUE)

    def _scan(self, i: int, until: str | None) -> int:
        """Tokens from i on; with until, to the brace that closes an embedded expression. Returns the place behind."""
        code, deep = self.code, 0
        while i < len(code):
            c = code[i]
            if m := _SPACE.match(code, i):
                self.line += m[0].count("\n")
                i = m.end()
            elif code.startswith(("//", "/*"), i):
                end = code.find("\n" if code[i + 1] == "/" else "*/", i + 2)
                if end < 0:
                    if code[i + 1] == "*":
                        raise ValueError("comment isn't closed")
                    end = len(code)
                self.comment = code[i + 2 : end]
                i = end + (2 if code[i + 1] == "*" else 0)
                self.line += self.comment.count("\n")
            elif c in "\"'":
                i = self._string(i)
            elif c == "`":
                i = self._template(i)
            elif c == "/" and self._expects_value() and (m := re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*").match(code, i)):
                self._put("re", m[0])
                i = m.end()
            elif c == "<" and self.jsx and self._expects_value() and re.match(r"<(?:>|[A-Za-z_$][\w$.:-]*(?=[\s/>])(?!\s+extends\b))", code[i : i + 200]):
                i = self._element(i)
            elif c == "#" and i == 0 and code.startswith("#!"):
                i = code.find("\n") if "\n" in code else len(code)
            elif m := _IDENT.match(code, i) or _NUMBER.match(code, i):
                self._put("num" if c.isdigit() else "id", m[0])
                i = m.end()
            else:
                m = _PUNCT.match(code, i)
                if until and m[0] == "}" and not deep:
                    return i + 1
                deep += (m[0] == "{") - (m[0] == "}")
                self._put(m[0], m[0])
                i = m.end()
        if until:
            raise ValueError("an embedded expression isn't closed")
        return i

    def _string(self, i: int) -> int:
        m = re.compile(r"\"((?:\\[\s\S]|[^\"\\\n])*)\"|'((?:\\[\s\S]|[^'\\\n])*)'").match(self.code, i)
        if not m:
            raise ValueError(f"line {self.line}: string isn't closed")
        self._put("str", m[1] if m[1] is not None else m[2])
        return m.end()

    def _template(self, i: int) -> int:
        mark, part, parts = len(self), "", []
        self._put("tmpl", "", parts)
        i += 1
        while i < len(self.code):
            c = self.code[i]
            if c == "\\":
                part, i = part + self.code[i : i + 2], i + 2
            elif c == "`":
                self[mark].parts = [*parts, part]
                return i + 1
            elif self.code.startswith("${", i):
                parts.append(part)
                part = ""
                self._put("(", "(")
                i = self._scan(i + 2, "}")
                self._put(")", ")")
            else:
                self.line += c == "\n"
                part, i = part + c, i + 1
        raise ValueError("template isn't closed")

    def _element(self, i: int) -> int:
        """An element: one jsx token, and in brackets the tokens of the expressions inside."""
        self._put("jsx", "<")
        code, m = self.code, re.compile(r"<\s*([\w$.:-]*)").match(self.code, i)
        i = m.end()
        while True:  # attributes
            if i >= len(code):
                raise ValueError("element isn't closed")
            if code.startswith("/>", i):
                return i + 2
            if code[i] == ">":
                i += 1
                break
            i = self._inside(i, quotes=True)
        while True:  # children
            if i >= len(code):
                raise ValueError("element isn't closed")
            if code.startswith("</", i):
                return code.index(">", i) + 1
            i = self._element(i) if code[i] == "<" else self._inside(i, quotes=False)

    def _inside(self, i: int, quotes: bool) -> int:
        c = self.code[i]
        if c == "{":
            self._put("(", "(")
            i = self._scan(i + 1, "}")
            self._put(")", ")")
            return i
        if quotes and c in "\"'":
            end = self.code.index(c, i + 1)
            self.line += self.code.count("\n", i, end)
            return end + 1
        self.line += c == "\n"
        return i + 1


def _doc(comment: str | None) -> str:
    lines = (re.sub(r"^\s*\*?\s?", "", x).strip() for x in (comment or "").split("\n"))
    return " ".join(filter(None, lines))[:400]


class _Reader:
    def __init__(self, code: str, jsx: bool):
        self.t = Tokens(code, jsx)
        self.n = len(self.t)
        self.out = analysis()
        self.open: list[tuple[dict, int]] = []
        self.classes: list[tuple[str, int, int]] = []

    # -- small views -------------------------------------------------------
    def kind(self, i: int) -> str:
        return self.t[i].kind if 0 <= i < self.n else ""

    def word(self, i: int) -> str:
        return self.t[i].value if 0 <= i < self.n and self.t[i].kind == "id" else ""

    def starts_statement(self, i: int) -> bool:
        return i < 0 or self.kind(i) in (";", "{", "}") or self.word(i) in ("export", "default", "else", "do") or (self.kind(i) == ")" and self.t[i + 1].line > self.t[i].line)

    def chain(self, i: int) -> tuple[str, int, bool]:
        """(member path that ends at token i, its first token, whether it is optional): names joined by dots."""
        names, optional = [], False
        while True:
            if self.kind(i) == "id":
                names.append(self.t[i].value)
            elif self.kind(i) in (")", "]"):  # a call or an index in the chain has no name
                i = self.t[i].mate
                if self.kind(i - 1) in ("id", ")", "]") and self.word(i - 1) not in _NOT_CALLS:
                    _, i, more = self.chain(i - 1)
                    optional |= more
                break
            else:
                return ".".join(reversed(names)), i + 1, optional
            if self.kind(i - 1) in (".", "?."):
                optional |= self.kind(i - 1) == "?."
                i -= 2
            else:
                break
        return ".".join(reversed(names[:8])), i, optional

    def before_types(self, i: int) -> int:
        """The token before the bracket at i, or before the type arguments that stand between: `f` of `f<A, B[]>(`.

        Between `<` and `>` stand only names, literals, closed brackets and the marks of types, and two names in a row
        only as an operator of types has them; anything else is a comparison.
        """
        j, deep = i - 1, 0
        if self.kind(j) != ">":
            return j
        while j >= 0 and deep <= _DEEPEST_TYPE:
            k = self.kind(j)
            if k == ">":
                deep += 1
            elif k == "<":
                deep -= 1
                if not deep:
                    return j - 1 if self.kind(j - 1) == "id" else i - 1
            elif k in ("id", ")", "]", "}"):
                if self.kind(j + 1) == "id" and self.word(j) not in _TYPE_PREFIX and self.word(j + 1) != "extends":
                    break
                j = self.t[j].mate if k != "id" else j
            elif k not in ("str", "num", ".", ",", "|", "&", "=>"):
                break
            j -= 1
        return i - 1

    def after_types(self, i: int) -> int:
        """The token behind the type parameters or arguments that open at i; i where there are none."""
        j, deep = i, 0
        while self.kind(j) not in ("", ")", "]", "}", ";", "&&", "||") and deep <= _DEEPEST_TYPE:
            deep += (self.kind(j) == "<") - (self.kind(j) == ">")
            if not deep:
                return j + (j > i)
            j = self.t[j].mate + 1 if self.kind(j) in ("(", "[", "{") else j + 1
        return i

    def params(self, i: int) -> list[str]:
        """Names of the parameters in the brackets that open at i; of the one at i, where it stands without any."""
        if self.kind(i) == "id":
            return [self.t[i].value]
        out, a = [], i + 1
        while a < self.t[i].mate:
            b = a
            while b < self.t[i].mate and self.kind(b) != ",":
                b = self.t[b].mate + 1 if self.kind(b) in ("(", "[", "{") else b + 1
            if b > a:
                out.append(self._param(a, b))
            a = b + 1
        return out

    def _param(self, a: int, b: int) -> str:
        top, j = [], a
        while j < b:
            top.append(self.kind(j))
            j = self.t[j].mate + 1 if self.kind(j) in ("(", "[", "{") else j + 1
        if self.kind(a) == "...":
            return f"...{self.word(a + 1) or 'rest'}"
        if self.kind(a) == "id":
            return "arg" if self.kind(a + 1) == "id" else self.t[a].value
        if "=" in top:
            return "arg"
        if self.kind(a) == "{":
            keys, j = [], a + 1
            while j < self.t[a].mate:
                keys.append(self.t[j].value if self.kind(j) == "id" else "...")
                while j < self.t[a].mate and self.kind(j) != ",":
                    j = self.t[j].mate + 1 if self.kind(j) in ("(", "[", "{") else j + 1
                j += 1
            return f"{{ {', '.join(keys)} }}"
        return "[...]" if self.kind(a) == "[" else "arg"

    def function_at(self, i: int) -> tuple[int, int, bool] | None:
        """(place of the parameters, last token, async) of the function expression that begins at i."""
        is_async = self.word(i) == "async" and (self.kind(i + 1) in ("id", "(", "<"))
        j = self.after_types(i + is_async)
        if self.word(j) == "function":
            p = j + 1 + (self.kind(j + 1) == "*")
            p += self.kind(p) == "id"
            body = self.body(p)
            return (p, self.t[body].mate, is_async) if body else None
        arrow = j + 1 if self.kind(j) == "id" else self.t[j].mate + 1 if self.kind(j) == "(" else self.n
        if self.kind(arrow) == ":":  # a return type
            while arrow < self.n and self.kind(arrow) not in ("=>", ";", ",", ")"):
                arrow = self.t[arrow].mate + 1 if self.kind(arrow) in ("(", "[", "{") else arrow + 1
        return (j, self.end(arrow + 1), is_async) if self.kind(arrow) == "=>" else None

    def body(self, p: int) -> int | None:
        """The brace that opens the body behind the parameters at p."""
        if self.kind(p) == "<":
            while p < self.n and self.kind(p) != "(":
                p += 1
        if self.kind(p) != "(":
            return None
        j = self.t[p].mate + 1
        while j < self.n and self.kind(j) not in ("{", ";", "=>", ")"):
            j += 1
        return j if self.kind(j) == "{" else None

    def end(self, i: int) -> int:
        """The last token of the expression that begins at i."""
        j = i
        while j < self.n and self.kind(j) not in (",", ";", ")", "]", "}"):
            if j > i and self.t[j].line > self.t[j - 1].line and self.kind(j - 1) in ("id", "num", "str", "tmpl", "re", ")", "]", "}") and self.kind(j) == "id" and self.word(j) not in ("in", "of", "instanceof"):
                break
            if self.kind(j) == "<" and self.kind(j - 1) == "id":  # the comma between type arguments ends nothing
                after = self.after_types(j)
                if self.kind(after) == "(" and self.before_types(after) == j - 1:
                    j = after
            j = self.t[j].mate + 1 if self.kind(j) in ("(", "[", "{") else j + 1
        return j - 1

    # -- what is found -----------------------------------------------------
    def add(self, i: int, end: int, name: str, kind: str, params: list[str] | None, is_async: bool, doc: str, **more) -> dict:
        start, last = self.t[i].line, self.t[min(end, self.n - 1)].line
        signature = f"class {name}" if kind == "class" else f"{'async ' * is_async}{name}({', '.join(params or [])})"
        s = {"name": name, "qualified_name": name, "kind": kind, "class_name": "", "signature": signature, "params": params or [], "exported": False, "is_async": is_async, "doc": doc, "start_line": start, "end_line": last, "loc": max(1, last - start + 1), "calls": []} | more
        self.out["symbols"].append(s)
        return s

    def function_kind(self, name: str, a: int, b: int) -> str:
        if re.match("use[A-Z]", name):
            return "hook"
        return "component" if re.fullmatch("[A-Z][A-Za-z0-9]*", name) and any(x.kind == "jsx" for x in self.t[a : b + 1]) else "function"

    def imported(self, raw: str, names: list[str], line: int) -> None:
        if raw:
            self.out["imports"].append({"raw": raw, "specifiers": names, "is_external": is_external(raw), "line": line})

    def read(self) -> dict:
        for i in range(self.n):
            while self.open and self.open[-1][1] < i:
                self.open.pop()
            while self.classes and self.classes[-1][2] < i:
                self.classes.pop()
            w = self.word(i)
            member = self.kind(i - 1) in (".", "?.")
            if w == "import" and not member and self.kind(i + 1) != "(":
                self.import_(i)
            elif w == "export" and not member:
                self.export(i)
            elif w == "function" and not member and self.starts_statement(i - 1 - (self.word(i - 1) == "async")):
                self.declared_function(i)
            elif w == "class" and not member and self.starts_statement(i - 1 - (self.word(i - 1) == "abstract")) and self.kind(i + 1) == "id":
                self.class_(i)
            elif w in ("const", "let", "var") and not member:
                self.variables(i)
            elif self.kind(i) == "=":
                self.assignment(i)
            elif self.kind(i) == "(":
                self.method(i) or self.call(i)
        out = self.out
        out["exports"] = list(dict.fromkeys(filter(None, out["exports"])))
        for s in out["symbols"]:
            s["exported"] = s["name"] in out["exports"] or s["qualified_name"] in out["exports"]
        return out

    def import_(self, i: int) -> None:
        j, names = i + 1, []
        while j < self.n and self.kind(j) not in ("str", ";"):
            if self.kind(j) == "id" and self.t[j].value not in ("from", "as", "type") and self.word(j + 1) != "as":
                names.append(self.t[j].value)
            j += 1
        if self.kind(j) == "str":
            self.imported(self.t[j].value, names, self.t[i].line)

    def export(self, i: int) -> None:
        exports, j = self.out["exports"], i + 1
        if self.word(j) == "default":
            j += 1 + (self.word(j + 1) == "async")
            named = self.word(j) in ("function", "class")
            j += 1 + (self.kind(j + 1) == "*")
            exports.append(self.word(j) if named and self.word(j) not in ("", "extends") else "default")
        elif self.kind(j) in ("{", "*") or self.word(j) == "type" and self.kind(j + 1) == "{":
            j += self.word(j) == "type"
            if self.kind(j) == "{":
                for k in range(j + 1, self.t[j].mate):
                    if self.kind(k) in ("id", "str") and self.kind(k + 1) in (",", "}"):
                        exports.append(self.t[k].value)
                j = self.t[j].mate
            elif self.word(j + 1) == "as":
                exports.append(self.word(j + 2))
                j += 2
            if self.word(j + 1) == "from" and self.kind(j + 2) == "str":
                self.imported(self.t[j + 2].value, [], self.t[i].line)
        elif self.word(j) in ("const", "let", "var"):
            exports += [self.t[k].value for k in self.declarators(j)]
        else:
            while self.word(j) in ("async", "abstract", "declare", "function", "class", "interface", "type", "enum") or self.kind(j) == "*":
                j += 1
            exports.append(self.word(j))

    def declarators(self, i: int) -> list[int]:
        """Places of the plain names that the declaration at i introduces."""
        out, j = [], i + 1
        while j < self.n:
            if self.kind(j) == "id":
                out.append(j)
            while j < self.n and self.kind(j) not in (",", ";", ")", "]", "}"):
                if self.kind(j) == "=" or self.kind(j) == ":" and self.kind(j - 1) != "=":
                    if self.kind(j) == "=":
                        j = self.end(j + 1) + 1
                        break
                j = self.t[j].mate + 1 if self.kind(j) in ("(", "[", "{") else j + 1
                if j < self.n and j > i + 2 and self.word(j) in _STATEMENT and self.t[j].line > self.t[j - 1].line:
                    return out
            if self.kind(j) != ",":
                return out
            j += 1
        return out

    def declared_function(self, i: int) -> None:
        name_at = i + 1 + (self.kind(i + 1) == "*")
        name, body = self.word(name_at), self.body(name_at + 1)
        if not name or body is None:
            return
        opens = name_at + 1
        while self.kind(opens) != "(":  # type parameters
            opens += 1
        is_async = self.word(i - 1) == "async"
        a = i - is_async
        doc = _doc(self.t[a].comment) or _doc(self.statement_comment(a))
        s = self.add(a, self.t[body].mate, name, self.function_kind(name, body, self.t[body].mate), self.params(opens), is_async, doc)
        self.open.append((s, self.t[body].mate))

    def statement_comment(self, i: int) -> str | None:
        while self.word(i - 1) in ("export", "default", "abstract", "declare"):
            i -= 1
        return self.t[i].comment

    def class_(self, i: int) -> None:
        name, j = self.word(i + 1), i + 2
        while j < self.n and self.kind(j) != "{":
            j += 1
        if j == self.n:
            return
        parent = next((k for k in range(i + 2, j) if self.word(k) == "extends"), None)
        s = self.add(i, self.t[j].mate, name, "class", None, False, _doc(self.t[i].comment) or _doc(self.statement_comment(i)))
        if parent is not None:
            end = parent + 1
            while self.kind(end + 1) == "." and end + 2 < j:
                end += 2
            s["signature"] += f" extends {self.chain(end)[0]}"
        self.open.append((s, self.t[j].mate))
        self.classes.append((name, j, self.t[j].mate))

    def variables(self, i: int) -> None:
        doc = _doc(self.t[i].comment)
        for at in self.declarators(i):
            eq = at + 1
            while eq < self.n and self.kind(eq) not in ("=", ",", ";", ")", "}") and self.word(eq) not in ("of", "in"):
                eq = self.t[eq].mate + 1 if self.kind(eq) in ("(", "[", "{") else eq + 1
            if self.kind(eq) != "=":
                continue
            fn, via = self.function_at(eq + 1), None
            last = fn[1] if fn else self.end(eq + 1)
            if not fn and self.kind(last) == ")":
                name, first, optional = self.chain(self.before_types(self.t[last].mate))
                if first == eq + 1 and not optional and name:
                    fn, via = self.argument(self.t[last].mate), name.split(".")[-1]
            if fn:
                name, params = self.t[at].value, self.params(fn[0])
                s = self.add(at, last, name, self.function_kind(name, eq, last), params, fn[2], doc)
                if via:
                    s["signature"] += f" via {via}"
                self.open.append((s, last))

    def argument(self, i: int) -> tuple[int, int, bool] | None:
        """The first argument that is a function, of the call whose bracket opens at i."""
        j = i + 1
        while j < self.t[i].mate:
            if fn := self.function_at(j):
                return fn
            j = self.end(j) + 2
        return None

    def assignment(self, i: int) -> None:
        if self.kind(i - 1) not in ("id", "]") or self.kind(i + 1) == "=":
            return
        target, first, _ = self.chain(i - 1)
        if self.word(first - 1) in ("const", "let", "var") or self.kind(first - 1) in (",", "(") and "." not in target:
            return
        exports, j = self.out["exports"], i + 1
        if target in ("module.exports", "exports"):
            if self.kind(j) == "{":
                k = j + 1
                while k < self.t[j].mate:
                    k += self.word(k) == "async" and self.kind(k + 1) == "id"
                    if self.kind(k) in ("id", "str") and self.kind(k - 1) != "...":
                        exports.append(self.t[k].value)
                    k = self.end(k) + 2
            else:
                exports.append("default")
        elif target.startswith(("exports.", "module.exports.")):
            exports.append(target.split("exports.", 1)[1])
        parts = target.split(".")
        if len(parts) > 1 and parts[-1] and parts[-1] != "exports" and (fn := self.function_at(j)):
            s = self.add(first, fn[1], parts[-1], self.function_kind(parts[-1], j, fn[1]), self.params(fn[0]), fn[2], _doc(self.t[first].comment))
            s |= {"class_name": ".".join(parts[:-1]), "qualified_name": target}
            self.open.append((s, fn[1]))

    def method(self, i: int) -> bool:
        """A method of a class or an object literal whose parameters open at i."""
        name_at = self.before_types(i)
        if self.kind(name_at) not in ("id", "str") or self.kind(self.t[i].parent) != "{":
            return False
        body, in_class = self.body(i), bool(self.classes) and self.t[i].parent == self.classes[-1][1]
        if body is None or not in_class and (body != self.t[i].mate + 1 and self.kind(self.t[i].mate + 1) != ":"):
            return False
        a, is_async = name_at, False
        while self.word(a - 1) in ("async", "get", "set", "static", "public", "private", "protected", "override", "readonly") or self.kind(a - 1) == "*":
            a -= 1
            is_async |= self.word(a) == "async"
        name = self.t[name_at].value
        if name in _NOT_CALLS or name == "function" or self.kind(a - 1) == "#" or (self.kind(a - 1) not in ("{", ",") if not in_class else self.kind(a - 1) not in ("{", "}", ";", ")", "id", "num", "str", "]")):
            return False
        if not in_class and self.kind(a - 1) == "{" and not self.is_object(a - 1):
            return False
        s = self.add(a, self.t[body].mate, name, "method", self.params(i), is_async, _doc(self.t[a].comment))
        if in_class:
            s |= {"class_name": self.classes[-1][0], "qualified_name": f"{self.classes[-1][0]}.{name}"}
        self.open.append((s, self.t[body].mate))
        return True

    def is_object(self, i: int) -> bool:
        """Whether the brace at i opens an object literal rather than a block."""
        return self.kind(i - 1) in ("=", "(", ",", ":", "[", "?", "&&", "||", "??") or self.word(i - 1) in ("return", "default")

    def call(self, i: int) -> None:
        at = near = self.before_types(i)
        while self.kind(at) == ")":  # a call of what a call returns
            at = self.before_types(self.t[at].mate)
        if self.kind(at) != "id" or self.t[at].value in _NOT_CALLS and self.kind(at - 1) != "." or self.word(at - 1) == "function":
            if self.word(at) != "import":
                return
        line = self.t[self.chain(near)[1]].line if self.kind(near) == "id" else self.t[i].line
        path, first, optional = self.chain(at)
        name = self.t[at].value
        if self.kind(self.t[i].mate + 1) == "=>" and name == "async" or optional or self.word(first - 1) == "new":
            return
        if name in ("require", "import") and first == at and self.kind(i + 1) == "str":
            return self.imported(self.t[i + 1].value, [], line)
        if name == "import":
            return None
        receiver = self.chain(at - 2)[0] if self.kind(at - 1) == "." else ""
        self.route(i, first, name, receiver, line)
        around = self.open[-1][0] if self.open else None
        self.out["calls"].append({"from": around["qualified_name"] if around else "<module>", "to": name, "receiver": receiver, "line": line})
        if around and name not in around["calls"]:
            around["calls"].append(name)
        return None

    def route(self, i: int, first: int, verb: str, receiver: str, line: int) -> None:
        if verb not in VERBS or not receiver or not _ROUTER.match(receiver.split(".")[-1]) or self.kind(i + 1) not in ("str", "tmpl"):
            return
        path = self.t[i + 1].value if self.kind(i + 1) == "str" else ":param".join(self.t[i + 1].parts)
        handlers, j = [], self.end(i + 1) + 2
        while j < self.t[i].mate:
            last = self.end(j)
            if not self.function_at(j):
                end = last
                while self.kind(end) == ")":
                    end = self.t[end].mate - 1
                if self.kind(end) == "id" and self.chain(end)[1] == j:
                    handlers.append(self.chain(end)[0] if end == last else self.t[end].value)
            j = last + 2
        handler = ", ".join(handlers)
        name = f"{verb.upper()} {path}"
        self.out["routes"].append({"method": verb.upper(), "path": path, "handler": handler, "line": line})
        s = self.add(first, self.t[i].mate, name, "route", None, False, _doc(self.t[first].comment))
        s |= {"signature": f"{name} -> {handler or 'inline handler'}", "calls": list(handlers)}


def analyze_javascript(code: str, jsx: bool = True) -> dict:
    """Imports, exports, symbols, routes and calls; parse_ok is false and all are empty where brackets don't close."""
    try:
        return _Reader(code, jsx).read()
    except (ValueError, IndexError):
        return analysis(parse_ok=False)
