"""The predicate language, compiled to columns: a=1&(b>2|!c.in(x,y)).

Precedence is ! over & over |, brackets nest. Logic has two values: a comparison with a missing
property is false, != is the complement of =, and ! is a true complement. `fields` and
names that start with _ are reserved and leave the predicate. Catalyst pushes
the resulting columns into the scan.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class InvalidQuery(ValueError):
    """A predicate that cannot be read."""


_TOKEN = re.compile(r"""\s*(?:(?P<mark>[()&|!](?!=))|(?P<name>[A-Za-z0-9_/.\[\],*-]*?)(?P<method>\.in|\.isEmpty)\((?P<list>[^)]*)\)|(?P<prop>[^\s()&|!<>=]+)\s*(?P<op><=|>=|!=|=|<|>)(?P<value>(?:\\.|[^()&|])*))""")


def tokens(text: str) -> list[tuple]:
    """('mark', c), ('compare', property, operator, literal), ('in', property, [..]), ('empty', category)."""
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise InvalidQuery(f"cannot read {text[at:]!r} at {at}")
        if m["mark"]:
            out.append(("mark", m["mark"]))
        elif m["method"] == ".in":
            values = [x.strip() for x in m["list"].split(",") if x.strip()]
            if not values:
                raise InvalidQuery(f"in() needs values: {m[0]!r}")
            out.append(("in", m["name"], values))
        elif m["method"]:
            out.append(("empty", m["name"]))
        else:
            out.append(("compare", m["prop"], m["op"], m["value"].strip()))
        at = m.end()
    return out


def _reserved(name: str) -> bool:
    return name == "fields" or name.startswith("_")


def _without_reserved(found: list[tuple]) -> list[tuple]:
    """Reserved comparisons go, with the operator that joins them."""
    out: list[tuple] = []
    skip = False
    for t in found:
        if t[0] == "compare" and _reserved(t[1]):
            if out and out[-1] in (("mark", "&"), ("mark", "|")):
                out.pop()
            else:
                skip = True
            continue
        if skip and t in (("mark", "&"), ("mark", "|")):
            skip = False
            continue
        skip = False
        out.append(t)
    return out


def parse(text: str):
    """('and' | 'or', [..]), ('not', x), or a leaf; None for the predicate that is always true."""
    found = _without_reserved(tokens(text))
    at = 0

    def peek():
        return found[at] if at < len(found) else None

    def take():
        nonlocal at
        at += 1
        return found[at - 1]

    def level(mark: str, name: str, below):
        parts = [below()]
        while peek() == ("mark", mark):
            take()
            parts.append(below())
        flat = [y for x in parts for y in (x[1] if x[0] == name else [x])]
        return flat[0] if len(flat) == 1 else (name, flat)

    def unary():
        t = peek()
        if t is None:
            raise InvalidQuery("an operand is missing at the end")
        if t == ("mark", "!"):
            take()
            return ("not", unary())
        if t == ("mark", "("):
            take()
            inner = either()
            if peek() != ("mark", ")"):
                raise InvalidQuery("a bracket is not closed")
            take()
            return inner
        if t[0] == "mark":
            raise InvalidQuery(f"unexpected {t[1]!r}")
        return take()

    def both():
        return level("&", "and", unary)

    def either():
        return level("|", "or", both)

    if not found:
        return None
    tree = either()
    if peek() is not None:
        raise InvalidQuery(f"unexpected {peek()[1]!r}")
    return tree


def property_column(name: str) -> Column:
    """category/name is a field of a struct or an entry of a map."""
    first, *rest = name.split("/")
    return reduce(lambda c, x: c[x], rest, F.col(f"`{first}`"))


def properties(tree) -> set[str]:
    if tree is None:
        return set()
    if tree[0] in ("and", "or"):
        return set().union(*map(properties, tree[1]))
    return properties(tree[1]) if tree[0] == "not" else {tree[1]}


def unsupported(tree_or_names, schema: T.StructType) -> list[str]:
    """Property ids that a schema lacks."""
    names = tree_or_names if isinstance(tree_or_names, (set, list)) else properties(tree_or_names)
    known = {f.name: f.dataType for f in schema}

    def missing(name: str) -> bool:
        first, *rest = name.split("/")
        kind = known.get(first)
        for x in rest:
            if isinstance(kind, T.MapType):
                kind = kind.valueType
            elif isinstance(kind, T.StructType) and x in kind.names:
                kind = kind[x].dataType
            else:
                return True
        return kind is None

    return sorted(x for x in names if missing(x))


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _compare(name: str, op: str, literal: str, kind: T.DataType | None) -> Column:
    c = property_column(name)
    if literal.lower() == "null" and op in ("=", "!="):
        return c.isNull() if op == "=" else c.isNotNull()
    number = _number(literal)
    if number is None or isinstance(kind, (T.DateType, T.TimestampType)):
        left, right = (c if isinstance(kind, (T.DateType, T.TimestampType)) else c.cast("string")), F.lit(literal)
    else:
        numeric = isinstance(kind, T.NumericType)
        whole = literal.lstrip("+-").isdigit()
        left, right = (c if numeric else c.try_cast("double")), F.lit(int(literal)) if whole else F.lit(number)
    found = {"=": lambda: left == right, "!=": lambda: left == right, "<": lambda: left < right, "<=": lambda: left <= right, ">": lambda: left > right, ">=": lambda: left >= right}[op]()
    return ~F.coalesce(found, F.lit(False)) if op == "!=" else F.coalesce(found, F.lit(False))


def _kind(name: str, schema: T.StructType | None) -> T.DataType | None:
    first, *rest = name.split("/")
    kind = schema[first].dataType if schema and first in schema.names else None
    for x in rest:
        kind = kind.valueType if isinstance(kind, T.MapType) else kind[x].dataType if isinstance(kind, T.StructType) and x in kind.names else None
    return kind


def compile_tree(tree, schema: T.StructType | None = None) -> Column:
    if tree is None:
        return F.lit(True)
    head = tree[0]
    if head == "and":
        return reduce(Column.__and__, [compile_tree(x, schema) for x in tree[1]])
    if head == "or":
        return reduce(Column.__or__, [compile_tree(x, schema) for x in tree[1]])
    if head == "not":
        return ~compile_tree(tree[1], schema)
    if head == "in":
        return reduce(Column.__or__, [_compare(tree[1], "=", x, _kind(tree[1], schema)) for x in tree[2]])
    if head == "empty":
        c = property_column(tree[1])
        size = F.size(c) == 0 if isinstance(_kind(tree[1], schema), (T.MapType, T.ArrayType)) else F.lit(False)
        return c.isNull() | size
    return _compare(tree[1], tree[2], tree[3], _kind(tree[1], schema))


def predicate(text: str, schema: T.StructType | None = None) -> Column:
    tree = parse(text)
    if schema is not None and (bad := unsupported(tree, schema)):
        raise InvalidQuery(f"unsupported properties: {bad}")
    return compile_tree(tree, schema)


def fields_of(text: str) -> list[str]:
    """Properties asked for by fields=a,b/c."""
    return [x.strip() for m in re.finditer(r"(?:^|[&|?])fields=((?:\[[^\]]*\]|[^&|])*)", text) for x in re.findall(r"(?:[^,\[]|\[[^\]]*\])+", m[1])]


_TEMPORAL = re.compile(r"([^\[]+)\[(\d+)(?:,(-?\d+))?(?:,(-?\d+))?\]$")


def temporal(field: str) -> tuple[str, int, int, int] | None:
    """(property, start, end, step) of prop[start,end,step]; end and step are -1 if missing."""
    m = _TEMPORAL.match(field)
    return (m[1], int(m[2]), int(m[3] or -1), int(m[4] or -1)) if m else None


def project(df: DataFrame, names: list[str]) -> DataFrame:
    """*, category/*, category/name; names that df lacks raise."""
    if not names or names == ["*"]:
        return df
    plain = [temporal(x)[0] if temporal(x) else x.removesuffix("/*") for x in names]
    if bad := unsupported(plain, df.schema):
        raise InvalidQuery(f"unsupported properties: {bad}")
    return df.select(*[(_series(df.schema, *temporal(x)) if temporal(x) else property_column(p)).alias(p) for x, p in zip(names, plain, strict=True)])


def _series(schema: T.StructType, name: str, start: int, end: int, step: int) -> Column:
    """A property that maps times to numbers, from start to end (-1: open), averaged over steps (-1: as it is)."""
    kind = _kind(name, schema)
    if not isinstance(kind, T.MapType) or not isinstance(kind.valueType, T.NumericType):
        raise InvalidQuery(f"{name!r} is no series, so it has no interval")
    points = F.filter(F.map_entries(property_column(name)), lambda e: (e["key"] >= start) & ((e["key"] <= end) if end != -1 else F.lit(True)))
    if step == -1:
        return F.map_from_entries(points)

    def at(e: Column) -> Column:
        return F.floor((e["key"] - start) / step) * step + start

    starts = F.array_distinct(F.transform(points, at))

    def mean(x: Column) -> Column:
        own = F.filter(points, lambda e: at(e) == x)
        return F.aggregate(own, F.lit(0.0), lambda a, e: a + e["value"]) / F.size(own)

    return F.map_from_arrays(starts, F.transform(starts, mean))


def query(df: DataFrame, text: str, keys: dict | None = None) -> DataFrame:
    """Rows of df under a key predicate and a predicate string, with its fields."""
    if keys:
        df = df.where(reduce(Column.__and__, [F.col(k) == F.lit(v) for k, v in keys.items()]))
    return project(df.where(predicate(text, df.schema)), fields_of(text))


class Builder:
    """Fluent predicates: Builder().property('a').equals(1).and_().property('b').gt(2).column()"""

    def __init__(self):
        self.parts: list = []
        self.name: str | None = None
        self.negate = False

    def property(self, name: str) -> Builder:
        self.name = name
        return self

    def _leaf(self, op: str, value) -> Builder:
        leaf = ("compare", self.name, op, "null" if value is None else str(value))
        self.parts.append(("not", leaf) if self.negate else leaf)
        self.negate = False
        return self

    def equals(self, value) -> Builder:
        return self._leaf("=", value)

    def gt(self, value) -> Builder:
        return self._leaf(">", value)

    def ge(self, value) -> Builder:
        return self._leaf(">=", value)

    def lt(self, value) -> Builder:
        return self._leaf("<", value)

    def le(self, value) -> Builder:
        return self._leaf("<=", value)

    def not_(self) -> Builder:
        self.negate = True
        return self

    def and_(self) -> Builder:
        self.parts.append("and")
        return self

    def or_(self) -> Builder:
        self.parts.append("or")
        return self

    def tree(self):
        """and binds closer than or."""
        groups: list[list] = [[]]
        for x in self.parts:
            if x == "or":
                groups.append([])
            elif x != "and":
                groups[-1].append(x)
        ands = [g[0] if len(g) == 1 else ("and", g) for g in groups if g]
        return None if not ands else ands[0] if len(ands) == 1 else ("or", ands)

    def column(self, schema: T.StructType | None = None) -> Column:
        return compile_tree(self.tree(), schema)
