"""The filter language over metadata: syntax tree and parser. No Spark in here.

    either  = both (OR both)*            both = term (AND term)*
    term    = NOT term | '(' either ')' | field test
    test    = ('=' | '!=' | '<' | '>' | '<=' | '>=') literal | IN '(' literal (',' literal)* ')' | LIKE string
    literal = "text" | 'text' | integer | decimal | TRUE | FALSE

Keywords are read in any case and are no field names. Backslashes in strings keep the next character
from ending the string and stay in its value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from nearfield.errors import FilterParseError

Literal = str | int | float | bool | None


@dataclass(frozen=True)
class Filter:
    """A node of the tree."""


@dataclass(frozen=True)
class And(Filter):
    left: Filter
    right: Filter


@dataclass(frozen=True)
class Or(Filter):
    left: Filter
    right: Filter


@dataclass(frozen=True)
class Not(Filter):
    inner: Filter


@dataclass(frozen=True)
class Compare(Filter):
    """A field against one literal; op is one of = != < > <= >=."""

    field: str
    op: str
    value: Literal

    def __eq__(self, other: object) -> bool:
        # 1, 1.0 and True are equal in Python and different literals here.
        return isinstance(other, Compare) and (self.field, self.op, type(self.value), self.value) == (other.field, other.op, type(other.value), other.value)

    __hash__ = None  # type: ignore[assignment]


@dataclass(frozen=True)
class In(Filter):
    field: str
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Like(Filter):
    """A string field against a pattern; % is special at the two ends alone."""

    field: str
    pattern: str


_TOKEN = re.compile(
    r"""\s*(?:
      (?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')
    | (?P<number>-?[0-9]+(?:\.[0-9]*)?)
    | (?P<word>[^\W\d][\w%]*)
    | (?P<sign>!=|<=|>=|[=<>(),])
    )""",
    re.VERBOSE | re.DOTALL,
)
_KEYWORDS = {"AND", "OR", "NOT", "IN", "LIKE", "TRUE", "FALSE"}
_COMPARISONS = {"=", "!=", "<", ">", "<=", ">="}


def tokenize(text: str) -> list[tuple[str, object, int]]:
    """(kind, value, position); kinds are string, number, field, keyword and sign."""
    out: list[tuple[str, object, int]] = []
    at, end = 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            where = at + len(text[at:]) - len(text[at:].lstrip())
            what = "unterminated string" if text[where] in "\"'" else f"unexpected character {text[where]!r}"
            raise FilterParseError(f"{what} at position {where}")
        kind, raw, start = m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)
        value: object = raw
        if kind == "string":
            value = raw[1:-1]
        elif kind == "number":
            value = float(raw) if "." in raw else int(raw)
            if isinstance(value, int) and not -(1 << 63) <= value < 1 << 63:
                raise FilterParseError(f"invalid integer: {raw}")
        elif kind == "word":
            kind, value = ("keyword", raw.upper()) if raw.upper() in _KEYWORDS else ("field", raw)
        out.append((kind, value, start))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str):
        self.tokens = tokenize(text)
        self.at = 0

    def peek(self) -> tuple[str, object]:
        return self.tokens[self.at][:2] if self.at < len(self.tokens) else ("end", None)

    def take(self, kind: str, value: object = None) -> object | None:
        """The next token's value if it is of this kind (and value), else None."""
        k, v = self.peek()
        if k != kind or value is not None and v != value:
            return None
        self.at += 1
        return v

    def fail(self, wanted: str) -> FilterParseError:
        if self.at >= len(self.tokens):
            return FilterParseError(f"expected {wanted}, got the end")
        _, v, where = self.tokens[self.at]
        return FilterParseError(f"expected {wanted}, got {v!r} at position {where}")

    #: How tightly the two joining keywords bind, and what they make.
    JOINS = ({"OR": Or}, {"AND": And})

    def expression(self, level: int = 0) -> Filter:
        if level == len(self.JOINS):
            return self.term()
        left = self.expression(level + 1)
        while (word := self.peek()) [0] == "keyword" and word[1] in self.JOINS[level]:
            self.at += 1
            left = self.JOINS[level][word[1]](left, self.expression(level + 1))
        return left

    def term(self) -> Filter:
        if self.take("keyword", "NOT"):
            return Not(self.term())
        if self.take("sign", "("):
            inner = self.expression()
            if not self.take("sign", ")"):
                raise self.fail("')'")
            return inner
        field = self.take("field")
        if field is None:
            raise self.fail("field name")
        if self.take("keyword", "IN"):
            return In(field, self.literals())
        if self.take("keyword", "LIKE"):
            pattern = self.take("string")
            if pattern is None:
                raise self.fail("a string after LIKE")
            return Like(field, pattern)
        kind, op = self.peek()
        if kind == "end":
            raise FilterParseError(f"expected operator after field '{field}'")
        if op not in _COMPARISONS or kind != "sign":
            raise FilterParseError(f"unknown operator: {op}")
        self.at += 1
        return Compare(field, op, self.literal())

    def literals(self) -> tuple[Literal, ...]:
        if not self.take("sign", "("):
            raise self.fail("'(' after IN")
        out = [self.literal()]
        while self.take("sign", ","):
            out.append(self.literal())
        if not self.take("sign", ")"):
            raise self.fail("',' or ')'")
        return tuple(out)

    def literal(self) -> Literal:
        kind, value = self.peek()
        if kind == "keyword" and value in ("TRUE", "FALSE"):
            value = value == "TRUE"
        elif kind not in ("string", "number"):
            raise self.fail("literal value")
        self.at += 1
        return value


def parse(text: str) -> Filter:
    reader = _Reader(text)
    if not reader.tokens:
        raise FilterParseError("empty filter")
    tree = reader.expression()
    if reader.at < len(reader.tokens):
        raise reader.fail("the end")
    return tree


def unparse(tree: Filter) -> str:
    """Text that parses to the tree, fully parenthesised."""

    def literal(v: Literal) -> str:
        if isinstance(v, str):
            return f'"{v}"' if '"' not in v else f"'{v}'"
        return str(v).upper() if isinstance(v, bool) else repr(v)

    match tree:
        case And(a, b):
            return f"({unparse(a)}) AND ({unparse(b)})"
        case Or(a, b):
            return f"({unparse(a)}) OR ({unparse(b)})"
        case Not(a):
            return f"NOT ({unparse(a)})"
        case Compare(f, op, v):
            return f"{f} {op} {literal(v)}"
        case In(f, vs):
            return f"{f} IN ({', '.join(map(literal, vs))})"
        case Like(f, p):
            return f"{f} LIKE {literal(p)}"
    raise TypeError(tree)
