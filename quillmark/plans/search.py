"""The search language: parsed to a tree, compiled to a match column and a score column over token arrays.

A table is prepared once (`indexed`): each text field gets its tokens, which are written, so that
no query cuts texts into words again. Clauses compile
to higher-order functions over them, so matching and scoring stay in one narrow scan with field filters
pushed down; a phrase or proximity is tried only on rows that hold its words. Document frequencies of the query's terms, which are few, come from one
aggregate over the same scan.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions.dates import date_bounds
from quillmark.functions.text import ENGLISH_STOP_WORDS, PLURALS, Synonyms, without_accents, words
from quillmark.session import written

#: Fixed limits: terms, generated terms, characters of a query.
MAX_TERMS, MAX_GENERATED, MAX_QUERY, MAX_CLAUSES = 20_000, 100_000, 65_536, 100_000


class SearchError(ValueError):
    """A query that breaks a limit or cannot be read."""


@dataclass
class Options:
    fields: tuple[str, ...] = ("text",)
    every: tuple[str, ...] = ()
    operator: str = "AND"
    upper_not: bool = True
    upper_ops: bool = False
    tie: float = 0.01
    slop: int = 0
    near_slop: int = 15
    similarity: float = 2.0
    bigram_slop: int = 50
    bigram_boost: float = 1.0
    trigram_boost: float = 1.0
    relevance: bool = True
    stem: bool = False
    synonyms: Synonyms | None = None
    expand: bool = True
    stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS
    alternate: str = "*:*"
    at_least: str | None = None
    like_terms: int = 12
    max_clauses: int = MAX_CLAUSES
    span_fuzzy: bool = True
    functions: dict[str, Column] = field(default_factory=dict)


# ---- tree

@dataclass
class Node:
    kind: str
    text: str = ""
    parts: list = field(default_factory=list)
    field: str | None = None
    boost: float = 1.0
    slop: int | None = None
    fuzzy: float | None = None
    low: str | None = None
    high: str | None = None
    closed: tuple[bool, bool] = (True, True)
    op: str = ""
    least: str | None = None
    stem: bool | None = None
    syn: bool | None = None


_LEX = re.compile(
    r"\s*(?:(?P<op>&&|\|\||!=|<=|>=|==|[<>()+\-!\[\]{}^~])|(?P<quote>\"(?:\\.|[^\"\\])*\"?)|(?P<word>(?:\\u[0-9a-fA-F]{4}|\\.|(?:https?|ftp):(?=//)|[^\s()\[\]{}\"^~<>!:|&]|!(?!=)(?<=\w!)|&(?!&)|\|(?!\|))+)(?P<colon>:)?|(?P<other>.))",
    re.S,
)


def _unescape(s: str) -> str:
    s = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), s)
    return re.sub(r"\\(.)", r"\1", s)


def lex(text: str) -> list[tuple[str, str, bool]]:
    """(kind, text, follows directly): op, quote, word, field."""
    if len(text) > MAX_QUERY:
        raise SearchError("the query is too long")
    out, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            break
        close = m.end() > at and not text[at : at + 1].isspace() and at > 0
        at = m.end()
        if m["op"]:
            out.append(("op", m["op"], close))
        elif m["quote"]:
            out.append(("quote", m["quote"].strip('"'), close))
        elif m["word"]:
            w = m["word"]
            signs = re.match(r"[+-]+(?=[^\s])", w)
            if signs and not out[-1:] == [("op", "^", True)]:
                out.append(("op", signs[0][0], close))
                w = w[signs.end() :]
            if w in ("-", "+"):
                out.append(("op", w, close))
            elif w:
                out.append(("field" if m["colon"] else "word", w, close))
    if sum(k in ("word", "quote") for k, _, _ in out) > MAX_TERMS:
        raise SearchError("the query has too many terms")
    return out


_WORDS = {"AND", "OR", "NOT", "NEAR", "BEFORE", "AFTER", "TO"}
_MODIFIERS = {"syn", "nosyn", "stem", "nostem", "like", "atleast", "debuglog", "near", "before", "after"}


class Parser:
    def __init__(self, text: str, options: Options):
        self.o, self.items, self.at = options, lex(text), 0
        self.state: dict = {"stem": None, "syn": None, "least": options.at_least}

    def peek(self, k: int = 0):
        return self.items[self.at + k] if self.at + k < len(self.items) else ("end", "", False)

    def keyword(self) -> str | None:
        kind, text, _ = self.peek()
        if kind == "op" and text in ("&&", "||"):
            return "AND" if text == "&&" else "OR"
        base = text.split(":")[0]
        if kind in ("word", "field") and base.upper() in _WORDS and (kind == "word" or base.upper() in ("NEAR", "BEFORE", "AFTER")):
            strict = self.o.upper_not if base.upper() == "NOT" else self.o.upper_ops
            if base == base.upper() or not strict and base == base.lower():
                return base.upper()
        return None

    def query(self, closing: str | None = None) -> Node:
        clauses: list[tuple[str, Node]] = []
        joins: list[str] = []
        pending, explicit = "", False
        while self.peek()[0] != "end":
            kind, text, _ = self.peek()
            if kind == "op" and text == ")":
                if closing:
                    break
                self.at += 1
                continue
            word = self.keyword()
            if word in ("AND", "OR"):
                self.at += 1
                pending, explicit = word, True
                continue
            occur = ""
            while True:
                kind, text, _ = self.peek()
                if kind == "op" and text in "+-!" and len(text) == 1:
                    occur, explicit = {"+": "must", "-": "not", "!": "not"}[text], True
                    self.at += 1
                elif self.keyword() == "NOT":
                    occur, explicit = "not", True
                    self.at += 1
                else:
                    break
            if self.peek()[0] == "end":
                break
            node = self.proximity()
            if node is None:
                continue
            if pending and clauses and pending == "AND" and clauses[-1][0] == "":
                clauses[-1] = ("must", clauses[-1][1])
            clauses.append((occur or ("must" if pending == "AND" else "should" if pending == "OR" else ""), node))
            if pending == "OR" and len(clauses) > 1 and clauses[-2][0] == "":
                clauses[-2] = ("should", clauses[-2][1])
            joins.append(pending)
            pending = ""
        free = "should" if explicit and any(o in ("must",) for o, _ in clauses) or self.o.operator == "OR" else "must"
        if self.state["least"]:
            free = "should"
        done = [(o or free, n) for o, n in clauses]
        node = Node("bool", parts=done, least=self.state["least"])
        if len(done) == 1 and done[0][0] != "not" and not node.least:
            return done[0][1]
        return node

    def proximity(self) -> Node | None:
        left = self.unit()
        while left is not None and (word := self.keyword()) in ("NEAR", "BEFORE", "AFTER"):
            kind, text, _ = self.peek()
            self.at += 1
            slop = self.o.near_slop
            if kind == "field" and self.peek()[0] == "word" and self.peek()[1].isdigit():
                slop = int(self.peek()[1])
                self.at += 1
            right = self.unit()
            if right is None:
                break
            pair = [right, left] if word == "AFTER" else [left, right]
            left = Node("near", parts=pair, slop=slop, op="unordered" if word == "NEAR" else "ordered", field=left.field)
        return left

    def unit(self, name: str | None = None) -> Node | None:
        kind, text, _ = self.peek()
        self.at += 1
        if kind == "field":
            low = text.lower()
            if low in _MODIFIERS:
                if low in ("syn", "nosyn"):
                    self.state["syn"] = low == "syn"
                elif low in ("stem", "nostem"):
                    self.state["stem"] = low == "stem"
                elif low == "atleast":
                    self.state["least"] = self.peek()[1]
                    self.at += 1
                elif low == "like":
                    kind, word, close = self.peek()
                    # a quoted text or a word that is no plain word, right after the colon, is the id of a document
                    document = close and (kind == "quote" or kind == "word" and not word.isalpha())
                    arg = self.unit(name)
                    return self.suffix(Node("like", parts=[arg], field=name, op="document" if document else "")) if arg else None
                elif low == "debuglog":
                    self.at += 1
                return None
            return self.unit(_unescape(text))
        if kind == "op" and text == "(":
            saved = dict(self.state)
            node = self.query(")")
            self.state = {**saved, "least": saved["least"]}
            if self.peek()[:2] == ("op", ")"):
                self.at += 1
            if name:
                node = _with_field(node, name)
            if self.peek()[:2] == ("op", "~") and self.peek(1)[0] == "word":
                least = self.peek(1)[1]
                self.at += 2
                parts = node.parts if node.kind == "bool" else [("should", node)]
                node = Node("bool", parts=[("should" if o == "must" else o, n) for o, n in parts], least=least)
            return self.suffix(node)
        if kind == "op" and text in "[{":
            return self.suffix(self.range(text, name))
        if kind == "op" and text in ("<", "<=", ">", ">=", "==", "!="):
            value = self.peek()[1]
            self.at += 1
            return self.suffix(Node("compare", text=_unescape(value), op=text, field=name))
        if kind == "quote":
            node = Node("phrase", text=_unescape(text), field=name, slop=self.o.slop, stem=self.state["stem"], syn=self.state["syn"])
            if self.peek()[:2] == ("op", "~"):
                self.at += 1
                if self.peek()[0] == "word" and re.fullmatch(r"\d+", self.peek()[1]):
                    node.slop = int(self.peek()[1])
                    self.at += 1
            return self.suffix(node)
        if kind == "word":
            follows = self.peek()
            if follows[0] == "op" and follows[1] in ("<", "<=", ">", ">=", "==", "!=") and name is None:
                self.at += 1
                value = self.peek()[1]
                self.at += 1
                return self.suffix(Node("compare", text=_unescape(value), op=follows[1], field=_unescape(text)))
            node = Node("term", text=text, field=name, stem=self.state["stem"], syn=self.state["syn"])
            if follows[:2] == ("op", "~"):
                self.at += 1
                node.fuzzy = self.o.similarity
                if self.peek()[0] == "word" and re.fullmatch(r"[\d.]+", self.peek()[1]):
                    node.fuzzy = float(self.peek()[1])
                    self.at += 1
            return self.suffix(node)
        return None

    def range(self, opening: str, name: str | None) -> Node:
        got: list[str] = []
        end = "]"
        while self.peek()[0] != "end":
            kind, text, _ = self.peek()
            self.at += 1
            if kind == "op" and text in "]}":
                end = text
                break
            got.append(("-" if got[-1:] == ["-"] and got.pop() else "") + text if kind != "field" else text + ":" + self.items[self.at][1])
            if kind == "field":
                self.at += 1
        mid = next((i for i, x in enumerate(got) if x.upper() == "TO"), len(got))
        low, high = " ".join(got[:mid]) or "*", " ".join(got[mid + 1 :]) or "*"
        closed = (opening == "[", end == "]")
        if low == high and low != "*" and closed == (True, True):
            return Node("compare", text=_unescape(low), op="==", field=name)
        return Node("range", field=name, low=None if low == "*" else _unescape(low), high=None if high == "*" else _unescape(high), closed=closed)

    def suffix(self, node: Node) -> Node:
        if self.peek()[:2] == ("op", "^") and re.fullmatch(r"[\d.]+", self.peek(1)[1] or ""):
            node.boost *= float(self.peek(1)[1])
            self.at += 2
        return node


def _with_field(node: Node, name: str) -> Node:
    if node.kind == "bool":
        return replace(node, parts=[(o, _with_field(n, name)) for o, n in node.parts])
    if node.kind == "near":
        return replace(node, parts=[_with_field(n, name) for n in node.parts], field=node.field or name)
    return replace(node, field=node.field or name)


def parse(text: str, options: Options | None = None) -> Node:
    """Tree of a query; an empty one is the alternate query."""
    options = options or Options()
    if not (text or "").strip():
        text = options.alternate
    if text.strip() in ("*:*", "*"):
        return Node("all")
    return Parser(text.replace("*:*", "ALLDOCS"), options).query()


# ---- scoring numbers

def tf(freq: Column) -> Column:
    return F.when(freq > 0, F.log1p(freq - 0.06) / math.log1p(0.94)).otherwise(0.0)


def _unscaled(df: float, n: float) -> float:
    return 1 + math.log((n + 0.25) / (df + 0.25))


_C = (128 / _unscaled(1, 10_000_000)) ** (1 / (10_000_000 - 1))


def idf(df: int, n: int) -> float:
    """sqrt((1 + ln((n + .25) / (df + .25))) * C ** (n - df)); C puts the squared value at 128 for one of ten million."""
    return math.sqrt(max(0.0, _unscaled(df, n)) * _C ** (n - df))


def length_norm(n: Column, boost: float = 1.0) -> Column:
    return boost * 10 / F.sqrt(n + 99)


def scaled_length_norm(n: Column, scale: float) -> Column:
    return scale * 10 / F.sqrt(n + 99)


def feedback_idf(df: int, n: int) -> float:
    """ln of the whole quotient n / (df + 1), plus 1."""
    return math.log(max(1, n // (df + 1))) + 1


def minimum_match(text: str, optional: int) -> int:
    """How many of the optional clauses must match: n% or above 19 a percentage, a decimal up to 1.0 a share, else a count."""
    text = text.strip()
    if text.endswith("%"):
        percent = float(text[:-1])
    elif "." in text and float(text) <= 1.0:
        percent = 100 * float(text)
    elif float(text) <= 19:
        return min(optional, int(float(text)))
    else:
        percent = float(text)
    return max(1, math.floor(optional * min(100.0, percent) / 100)) if optional else 0


# ---- compilation

def tokens_of(c: Column) -> Column:
    return words(without_accents(F.coalesce(c, F.lit(""))))


def indexed(docs: DataFrame, *fields: str) -> DataFrame:
    """docs with _t_<field>, the tokens of each text field, as a table written once; keep it for all queries.

    Inlined into a query, the tokens would be made anew wherever a clause names them, even inside of lambdas.
    """
    return written(docs.withColumns({f"_t_{f}": tokens_of(F.col(f)) for f in fields}), "index")


def _analyzed(text: str) -> list[str]:
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", plain)


def _edits(fuzzy: float, length: int) -> int:
    """Edits of a fuzzy value: whole numbers from 1 are edits, a share s allows (1 - s) * length; at most 2."""
    return min(2, int(fuzzy) if fuzzy >= 1 else int((1 - fuzzy) * length))


def _safe(test):
    return lambda x: F.coalesce(test(x), F.lit(False))


def _apart_from(bad: Column):
    return lambda x: ~F.exists(bad, lambda y: (y["s"] <= x["e"]) & (y["e"] >= x["s"]))


class Compiler:
    def __init__(self, schema: T.StructType, options: Options | None = None):
        self.schema, self.o = schema, options or Options()
        self.text = [f.name[3:] for f in schema if f.name.startswith("_t_")]
        self.kinds = {f.name: f.dataType for f in schema}
        self.terms: dict[tuple[str, str, str], Column] = {}
        self.generated = 0

    # every leaf is a test of one token, so that terms, wildcards and fuzzy terms share the rest

    def _test(self, node: Node, word: str):
        self.generated += 1
        if self.generated > MAX_GENERATED:
            raise SearchError("the query makes too many terms")
        if node.fuzzy is not None:
            k = _edits(node.fuzzy, len(word))
            return ("~", word, k), (lambda t: F.levenshtein(t, F.lit(word)) <= k)
        if re.search(r"(?<!\\)[*?]", word):
            if re.fullmatch(r"[^*?]+\*", word):
                return ("*", word, 0), (lambda t: F.startswith(t, F.lit(word[:-1].lower())))
            pattern = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in word.lower()) + "$"
            return ("*", word, 0), (lambda t: t.rlike(pattern))
        stem = self.o.stem if node.stem is None else node.stem
        if stem:
            own = PLURALS.column(F.lit(word))
            return ("s", word, 0), (lambda t: PLURALS.column(t) == own)
        return ("=", word, 0), (lambda t: t == F.lit(word))

    def _words(self, node: Node) -> list[str]:
        if re.search(r"(?<!\\)[*?]", node.text) and node.kind == "term":
            return [re.sub(r"[^\w*?]", "", node.text)]
        return _analyzed(_unescape(node.text))

    def fields(self, node: Node) -> list[str]:
        if node.field in (None, "DEFAULT"):
            return list(self.o.fields)
        if node.field in ("ALL", "*"):
            return list(self.o.every or self.text)
        if node.field not in self.kinds:
            raise SearchError(f"unknown field {node.field!r}")
        return [node.field]

    def _places(self, f: str, test) -> Column:
        t = F.col(f"_t_{f}")
        return F.filter(F.transform(t, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())

    def _freq(self, f: str, key: tuple, test) -> Column:
        return self._counted(f, key, test)[1]

    def _counted(self, f: str, key: tuple, test) -> tuple[Column, Column]:
        """(occurs, frequency) of a term, noted for the statistics; whole words are looked up without a lambda."""
        out = F.size(F.filter(F.col(f"_t_{f}"), lambda x: F.coalesce(test(x), F.lit(False))))
        occurs = F.array_contains(f"_t_{f}", key[1]) if key[0] == "=" else out > 0
        self.terms[(f, str(key[0]), f"{key[1]}/{key[2]}")] = occurs
        return occurs, F.when(occurs, out).otherwise(0) if key[0] == "=" else out

    def _required(self, node: Node, f: str) -> Column:
        """Whether a row holds the whole words that a phrase or proximity cannot do without: cheap, so it goes first."""
        if node.kind == "near":
            return self._required(node.parts[0], f) & self._required(node.parts[1], f)
        if node.kind == "bool":
            return F.lit(True)
        items = node.text.lower().split() if node.kind == "phrase" else self._words(node)
        keys = [self._test(replace(node, fuzzy=None), w)[0] for w in items if re.fullmatch(r"[^\W_]+", w)] if node.fuzzy is None else []
        return reduce(Column.__and__, [F.array_contains(f"_t_{f}", k[1]) for k in keys if k[0] == "="], F.lit(True))

    def _phrase_places(self, f: str, node: Node, items: list[str], fuzzy: float | None = None) -> Column:
        """First places at which the words (or words like them) stand in order; * is any word; with slop each may move."""
        t, slop = F.col(f"_t_{f}"), node.slop or 0
        real = [(i, self._test(replace(node, fuzzy=fuzzy), w)[1]) for i, w in enumerate(items) if w != "*"]
        first, lead = real[0]

        def fits(p: Column) -> Column:
            tests = []
            for i, test in real[1:]:
                off = i - first
                if slop == 0:
                    tests.append(F.coalesce(test(F.get(t, p + off)), F.lit(False)))
                else:
                    start = F.greatest(F.lit(0), p + off - slop)
                    near = F.slice(t, start + 1, p + off + slop - start + 1)  # ends slop after the place, also where the text's start cuts it
                    tests.append(F.exists(near, _safe(test)))
            return reduce(Column.__and__, tests, F.lit(True))

        return F.filter(self._places(f, lead), fits)

    def _leaf(self, node: Node, f: str) -> tuple[Column, Column]:
        """(match, frequency) in one field."""
        if f"_t_{f}" not in self.kinds:
            kind = self.kinds.get(f)
            if isinstance(kind, T.StringType) and re.search(r"[*?]", node.text):
                pattern = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in node.text) + "$"
                hit = F.col(f).rlike(pattern)
            else:
                hit = self._compare(f, "==", _unescape(node.text))
            hit = F.coalesce(hit, F.lit(False))
            return hit, hit.cast("int")
        items = re.findall(r"[^\W_]+[*?]*|\*", node.text.lower()) if node.kind == "phrase" else self._words(node)
        if node.kind == "phrase":
            items = [_analyzed(x)[0] if not re.search(r"[*?]", x) and _analyzed(x) else x for x in items]
        if not items:
            return F.lit(False), F.lit(0)
        if len([x for x in items if x != "*"]) == 1 and (node.kind != "phrase" or len(items) == 1):
            word = next(x for x in items if x != "*")
            found = [self._counted(f, *self._test(node, w)) for w in self._variants(node, word)]
            return reduce(Column.__or__, [x for x, _ in found]), reduce(lambda a, b: a + b, [x for _, x in found])
        if node.fuzzy is not None:
            tests = [self._freq(f, *self._test(node, w)) for w in items]
            every = reduce(Column.__and__, [x > 0 for x in tests])
            if not self.o.span_fuzzy:
                return every, F.least(*tests)
            # next to each other and in order
            places = F.size(self._phrase_places(f, replace(node, slop=0), items, node.fuzzy))
            return every & (places > 0), F.when(every, places).otherwise(0)
        places = F.size(self._phrase_places(f, node, items))
        for w in items:
            if w != "*":
                self._freq(f, *self._test(node, w))
        first = self._required(replace(node, kind="phrase", text=" ".join(items)), f)
        return first & (places > 0), F.when(first, places).otherwise(0)

    def _variants(self, node: Node, word: str) -> list[str]:
        use = self.o.expand if node.syn is None else node.syn
        if not (use and self.o.synonyms) or node.fuzzy is not None:
            return [word]
        return [" ".join(x) for x in self.o.synonyms.lookup([word])[0] if len(x) == 1] or [word]

    def _compare(self, f: str, op: str, text: str) -> Column:
        kind, c = self.kinds.get(f), F.col(f)
        dates = date_bounds(text) if isinstance(kind, (T.TimestampType, T.DateType)) else None
        if dates:
            low, high = (F.lit(x).cast("timestamp") for x in dates)
            return {"==": c.between(low, high), "!=": ~c.between(low, high), "<": c < low, "<=": c <= high, ">": c > high, ">=": c >= low}[op]
        value: Column = F.lit(text)
        if isinstance(kind, T.NumericType):
            value = F.lit(text).try_cast("double")
        elif isinstance(kind, T.ArrayType):
            return F.array_contains(c, text) if op == "==" else ~F.array_contains(c, text)
        return {"==": c == value, "!=": ~F.coalesce(c == value, F.lit(False)), "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]

    def _range(self, node: Node) -> Column:
        tests = []
        for f in self.fields(node):
            own = F.col(f).isNotNull()
            if node.low is not None and self._usable(f, node.low):
                own = own & self._compare(f, ">=" if node.closed[0] else ">", node.low)
            if node.high is not None and self._usable(f, node.high):
                own = own & self._compare(f, "<=" if node.closed[1] else "<", node.high)
            tests.append(F.coalesce(own, F.lit(False)))
        return reduce(Column.__or__, tests)

    def _usable(self, f: str, text: str) -> bool:
        """A bound that does not parse is open."""
        if isinstance(self.kinds.get(f), T.NumericType):
            return bool(re.fullmatch(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", text))
        return not isinstance(self.kinds.get(f), (T.TimestampType, T.DateType)) or date_bounds(text) is not None

    def _spans(self, node: Node, f: str) -> Column:
        """Places (first, last) of a term, phrase or proximity."""
        if node.kind == "near":
            a, b = (self._spans(x, f) for x in node.parts)
            slop = node.slop

            def joined(x: Column) -> Column:
                fit = F.filter(b, lambda y: ((y["s"] > x["e"]) & (y["s"] - x["e"] - 1 <= slop)) | (F.lit(node.op == "unordered") & (x["s"] > y["e"]) & (x["s"] - y["e"] - 1 <= slop)))
                return F.transform(fit, lambda y: F.struct(F.least(x["s"], y["s"]).alias("s"), F.greatest(x["e"], y["e"]).alias("e")))

            return F.flatten(F.transform(a, joined))
        if node.kind == "bool":
            parts = [self._spans(n, f) for o, n in node.parts if o != "not"]
            spans = F.concat(*parts)
            for o, n in node.parts:
                if o == "not":
                    spans = F.filter(spans, _apart_from(self._spans(n, f)))
            return spans
        items = self._words(node)
        if len(items) <= 1 and node.kind == "term":
            places, n = self._places(f, self._test(node, items[0] if items else "")[1]), 1
        else:
            places, n = self._phrase_places(f, node, items), len(items)
        return F.transform(places, lambda p: F.struct(p.alias("s"), (p + n - 1).alias("e")))

    def match(self, node: Node) -> Column:
        return self.both(node, None)[0]

    def both(self, node: Node, stats) -> tuple[Column, Column]:
        """(match, score); stats gives idf of (field, term), or None for a match alone."""
        if node.kind == "all" or node.kind == "term" and node.text == "ALLDOCS":
            return F.lit(True), F.lit(node.boost)
        if node.kind == "bool":
            return self._bool(node, stats)
        if node.kind == "range":
            hit = self._range(node)
            return hit, hit.cast("double") * node.boost
        if node.kind == "compare":
            hit = reduce(Column.__or__, [F.coalesce(self._compare(f, node.op, node.text), F.lit(False)) for f in self.fields(node)])
            return hit, hit.cast("double") * node.boost
        if node.kind == "near":
            freqs = [F.when(self._required(node, f), F.size(self._spans(node, f))).otherwise(0) for f in self.fields(node)]
            hit = reduce(Column.__or__, [x > 0 for x in freqs])
            return hit, reduce(lambda a, b: a + b, [tf(x) for x in freqs]) * node.boost
        if node.field == "_val_":
            # a function of the row as score: it matches every row
            name = node.text.strip()
            value = self.o.functions.get(name)
            if value is None:
                if not isinstance(self.kinds.get(name), T.NumericType):
                    raise SearchError(f"unknown function {name!r}")
                value = F.col(name)
            return F.lit(True), F.coalesce(value.cast("double"), F.lit(0.0)) * node.boost
        if node.kind == "like":
            inner = node.parts[0]
            if inner.kind == "bool":  # a group: any of its parts is enough
                return self.both(replace(inner, parts=[(o if o == "not" else "should", n) for o, n in inner.parts], boost=inner.boost * node.boost), stats)
            items = self._words(replace(inner, kind="phrase"))[: self.o.like_terms]
            return self.both(Node("bool", parts=[("should", Node("term", text=w, field=node.field or inner.field)) for w in items], boost=node.boost), stats)
        if node.kind == "term" and re.search(r"\w-\w", node.text) and not re.search(r"[*?]", node.text) and node.fuzzy is None:
            apart = Node("phrase", text=node.text.replace("-", " "), field=node.field, slop=0, stem=node.stem, syn=node.syn)
            return self.both(Node("bool", parts=[("should", apart), ("should", replace(node, text=node.text.replace("-", "")))], boost=node.boost), stats)
        hits, scores = [], []
        if not self.fields(node):
            raise SearchError("no field to search")
        for f in self.fields(node):
            before = set(self.terms)
            hit, freq = self._leaf(node, f)
            hits.append(hit)
            if f"_t_{f}" in self.kinds:
                weight = stats(f, set(self.terms) - before, node) if stats else 1.0
                scores.append(tf(freq) * weight * length_norm(F.size(f"_t_{f}")))
            else:
                scores.append(hit.cast("double"))
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        total = reduce(lambda a, b: a + b, scores)
        return reduce(Column.__or__, hits), (best + self.o.tie * (total - best)) * node.boost

    def _bool(self, node: Node, stats) -> tuple[Column, Column]:
        must, should, hide, scores = [], [], [], []
        if len(node.parts) > self.o.max_clauses:
            raise SearchError("the query has too many clauses")
        for o, n in node.parts:
            hit, score = self.both(n, stats)
            if o == "not":
                hide.append(~hit)
                continue
            (must if o == "must" else should).append(hit)
            scores.append(F.when(hit, score).otherwise(0.0))
        ok = reduce(Column.__and__, must + hide, F.lit(True))
        if should:
            need = minimum_match(node.least, len(should)) if node.least else (0 if must else 1)
            if need == 1:
                ok = ok & reduce(Column.__or__, should)
            elif need > 1:
                ok = ok & (reduce(lambda a, b: a + b, [x.cast("int") for x in should]) >= need)
        if self.o.relevance:
            scores += self._neighbours(node, stats)
        total = reduce(lambda a, b: a + b, scores) if scores else F.lit(1.0)
        return ok, total * node.boost

    def _neighbours(self, node: Node, stats) -> list[Column]:
        """Scores of adjacent text terms that stand near each other: pairs and triples as sloppy phrases."""
        out, run = [], []
        for o, n in [*node.parts, ("not", Node("end"))]:
            plain = n.kind == "term" and n.fuzzy is None and not re.search(r"[*?-]", n.text) and n.text != "ALLDOCS" and o != "not" and all(f"_t_{f}" in self.kinds for f in self.fields(n))
            if plain:
                run.append(n)
                continue
            for size, boost in ((2, self.o.bigram_boost), (3, self.o.trigram_boost)):
                for i in range(len(run) - size + 1):
                    group = run[i : i + size]
                    phrase = Node("phrase", text=" ".join(x.text for x in group), field=group[0].field, slop=self.o.bigram_slop, boost=boost)
                    hit, score = self.both(phrase, stats)
                    out.append(F.when(hit, score).otherwise(0.0))
            run = []
        return out


def matches(docs: DataFrame, text: str, options: Options | None = None) -> DataFrame:
    """Rows of an indexed table that match."""
    c = Compiler(docs.schema, options)
    return docs.where(c.match(parse(text, c.o)))


#: Fixed values of like: terms of a document, clauses, letters of a word at least.
LIKE_DOCUMENT_TERMS, LIKE_CLAUSES, LIKE_LETTERS = 15, 20, 4


def with_likes(docs: DataFrame, node: Node, key: str, options: Options) -> Node:
    """The tree with like:<document> replaced by the interesting terms of that row, any of which is enough."""
    if node.kind == "like" and node.op == "document":
        name = node.field or options.fields[0]
        row = docs.where(F.col(key).cast("string") == _unescape(node.parts[0].text))
        long = row.withColumn(f"_t_{name}", F.filter(f"_t_{name}", lambda w: (F.length(w) >= LIKE_LETTERS) & ~w.isin(*options.stop_words)))
        dfs = docs.select(key, F.col(f"_t_{name}"))
        terms = interesting_terms(long, name, key, LIKE_DOCUMENT_TERMS, 1, 1, against=dfs).orderBy("rank").limit(LIKE_CLAUSES).collect()
        return Node("bool", parts=[("should", Node("term", text=r["term"], field=name)) for r in terms], boost=node.boost)
    if node.kind == "bool":
        return replace(node, parts=[(o, with_likes(docs, n, key, options)) for o, n in node.parts])
    return node


def search(docs: DataFrame, text: str | Node, options: Options | None = None, filters: list[Column] | None = None, boost: Column | None = None, key: str | None = None) -> DataFrame:
    """Matching rows of an indexed table with score; filters do not change scores, boost multiplies them; key names the ids of like:<document>.

    Statistics of all terms of the query come from one aggregate over the table.
    """
    c = Compiler(docs.schema, options)
    node = parse(text, c.o) if isinstance(text, str) else text
    if key:
        node = with_likes(docs, node, key, c.o)
    c.both(node, None)
    names = list(c.terms)
    counted = docs.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c.terms[k]).alias(f"c{i}") for i, k in enumerate(names)]).first()
    dfs = {k: counted[f"c{i}"] for i, k in enumerate(names)}

    def stats(f: str, new: set, own: Node) -> float:
        keys = new or {k for k in dfs if k[0] == f and any(k[2].startswith(w + "/") for w in c._words(own) or [own.text])}
        return sum(idf(dfs[k], counted["n"]) for k in keys) or 1.0

    scorer = Compiler(docs.schema, c.o)
    hit, score = scorer.both(node, stats)
    rows = docs.where(reduce(Column.__and__, filters or [], hit))
    return rows.withColumn("score", score * boost if boost is not None else score)


def top(found: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Best rows, ties by key."""
    return found.orderBy(F.col("score").desc(), key).limit(n)


# ---- components around a query

def role_filter(schema: T.StructType, roles: list[str], filters: dict[str, list[str]], default: list[str], options: Options | None = None) -> Column:
    """All filters of a role must hold, any role is enough; default filters if no role is known."""
    c = Compiler(schema, options)
    known = [r for r in roles if r in filters]
    if known:
        return reduce(Column.__or__, [reduce(Column.__and__, [c.match(parse(q, c.o)) for q in filters[r]], F.lit(True)) for r in known])
    return reduce(Column.__or__, [c.match(parse(q, c.o)) for q in default]) if default else F.lit(False)


def acl_filter(tags: list[str] | None, acl: str = "acl", deny: str = "deny") -> Column:
    """A row is seen if it allows a tag and denies none; without tags nothing is."""
    if not tags:
        return F.lit(False)
    own = F.array(*[F.lit(x) for x in tags])
    return F.coalesce(F.arrays_overlap(acl, own), F.lit(False)) & ~F.coalesce(F.arrays_overlap(deny, own), F.lit(False))


def fail_closed(make) -> Column:
    """A filter, or nothing at all if it cannot be made."""
    try:
        return make()
    except Exception:  # noqa: BLE001  whatever is wrong, nothing may be shown
        return F.lit(False)


def interesting_terms(docs: DataFrame, field: str, key: str, n: int = 25, min_tf: int = 2, min_df: int = 5, against: DataFrame | None = None) -> DataFrame:
    """The n terms of each row with the greatest tf * idf; document frequencies are those of `against`, or of the rows themselves."""
    tfs = written(docs.select(key, F.explode(f"_t_{field}").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")), "tf")
    if against is None:
        dfs = tfs.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    else:
        wanted = tfs.select("term").distinct()
        dfs = against.select(F.explode(F.array_distinct(f"_t_{field}")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = (docs if against is None else against).count()
    rows = tfs.where(F.col("tf") >= min_tf).join(dfs.where(F.col("df") >= min_df), "term").withColumn("weight", F.col("tf") * (F.log(F.greatest(F.lit(1), F.floor(F.lit(total) / (F.col("df") + 1)))) + 1))
    order = Window.partitionBy(key).orderBy(F.col("weight").desc(), "term")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def rocchio(positive: DataFrame, negative: DataFrame, size: tuple[int, int], alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.15, original: dict[str, float] | None = None) -> DataFrame:
    """term, boost from rows (term, tf, idf) of relevant and irrelevant documents, best first."""
    up = positive.select("term", (F.lit(beta / max(1, size[0])) * F.col("tf") * F.greatest(F.col("idf") - 1, F.lit(1e-6))).alias("b"))
    down = negative.select("term", (F.lit(-gamma / max(1, size[1])) * F.col("tf") * F.greatest(F.col("idf") - 1, F.lit(1e-6))).alias("b"))
    rows = up.union(down)
    if original:
        rows = rows.union(positive.sparkSession.createDataFrame([(k, alpha * v) for k, v in original.items()], "term string, b double"))
    return rows.groupBy("term").agg(F.sum("b").alias("boost")).orderBy(F.col("boost").desc(), "term")


def with_feedback(docs: DataFrame, text: str, key: str, options: Options | None = None, top_x: int = 10, bottom_y: int = 10, terms: int = 25, min_tf: int = 2, min_df: int = 5, rounds: int = 1, mode: str = "relevancy") -> DataFrame:
    """Search again with terms of the best rows (and against those of the worst); the first query stays a must (relevancy) or a wish (recall)."""
    options = options or Options()
    name = options.fields[0]
    tree = parse(text, options)
    found = search(docs, tree, options)
    for _ in range(max(1, min(20, rounds))):
        ranked = found.select(key, "score", f"_t_{name}")
        best = ranked.orderBy(F.col("score").desc(), key).limit(top_x)
        worst = ranked.orderBy(F.col("score"), key).limit(bottom_y).join(best.select(key), key, "left_anti")
        total = docs.count()

        def weights(rows: DataFrame) -> DataFrame:
            return rows.select(key, F.explode(f"_t_{name}").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf")).where(F.col("tf") >= min_tf)

        wanted = weights(best).select("term").union(weights(worst).select("term")).distinct()
        dfs = docs.select(F.explode(F.array_distinct(f"_t_{name}")).alias("term")).join(wanted, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
        idfs = dfs.withColumn("idf", F.log(F.greatest(F.lit(1), F.floor(F.lit(total) / (F.col("df") + 1)))) + 1)
        boosts = rocchio(weights(best).join(idfs, "term"), weights(worst).join(idfs, "term"), (top_x, bottom_y)).where("boost > 0").limit(terms).collect()
        more = [("should", Node("term", text=r["term"], field=name, boost=r["boost"])) for r in boosts]
        found = search(docs, Node("bool", parts=[("must" if mode == "relevancy" else "should", tree), *more]), replace(options, relevance=False))
    return found


def apply_rules(found: DataFrame, rules: list[tuple[str, str, dict]], options: Options | None = None) -> DataFrame:
    """Rules (condition, action, arguments) over rows: boost (factor), hide, set (column, value); conditions are queries."""
    c = Compiler(found.schema, options)
    for condition, action, args in rules:
        hit = c.match(parse(condition, c.o))
        if action == "boost":
            found = found.withColumn("score", F.when(hit, F.col("score") * args["factor"]).otherwise(F.col("score")))
        elif action == "hide":
            found = found.where(~hit)
        elif action == "set":
            old = F.col(args["column"]) if args["column"] in found.columns else F.lit(None)
            found = found.withColumn(args["column"], F.when(hit, F.lit(args["value"])).otherwise(old))
        else:
            raise SearchError(f"unknown action {action!r}")
    return found


def landing_page(text: str, pages: dict[str, str]) -> str | None:
    """The page of an exact query."""
    return pages.get(" ".join(text.lower().split()))


def highlighted(docs: DataFrame, text: str, field: str = "text", mode: str = "BOTH", begin: str = "<b>", end: str = "</b>") -> DataFrame:
    """highlight (terms marked) and offsets (start, end of terms) of a field."""
    terms = sorted({w for w in _analyzed(text) if w.upper() not in _WORDS}, key=lambda x: (-len(x), x))
    pattern = r"(?iU)(?<![\p{L}\p{N}])(?:" + "|".join(map(re.escape, terms)) + r")(?![\p{L}\p{N}])"
    out = docs
    if mode in ("HIGHLIGHT", "BOTH"):
        out = out.withColumn("highlight", F.regexp_replace(field, f"({pattern})", f"{begin}$1{end}"))
    if mode in ("OFFSETS", "BOTH"):
        # pieces between terms give the places of terms
        cut = F.split(F.col(field), pattern)
        hits = F.regexp_extract_all(field, F.lit(f"({pattern})"), F.lit(1))
        ends = F.aggregate(
            F.arrays_zip(F.slice(cut, 1, F.size(hits)).alias("c"), hits.alias("h")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("o")),
            lambda a, x: F.struct((a["at"] + F.length(x["c"]) + F.length(x["h"])).alias("at"), F.concat(a["o"], F.array(F.struct((a["at"] + F.length(x["c"])).alias("start"), (a["at"] + F.length(x["c"]) + F.length(x["h"])).alias("end")))).alias("o")),
            lambda a: a["o"],
        )
        out = out.withColumn("offsets", ends)
    return out


def suggestions(dictionary: DataFrame, word: str, count: int = 5, edits: int = 2, min_share: float = 0.0) -> DataFrame:
    """Words (term, df) near a word, itself left out: by edits, frequency, term; df at least min_share of the word's own."""
    own = dictionary.where(F.col("term") == word).agg(F.coalesce(F.max("df"), F.lit(0)).alias("own"))
    near = dictionary.where(F.abs(F.length("term") - len(word)) <= edits).withColumn("edits", F.levenshtein("term", F.lit(word))).where((F.col("edits") <= edits) & (F.col("term") != word))
    return near.join(F.broadcast(own), F.lit(True)).where(F.col("df") >= F.col("own") * min_share).orderBy("edits", F.col("df").desc(), "term").limit(count).select("term", "df", "edits")


def facets(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def autocomplete(dictionary: DataFrame, prefix: str, count: int = 10) -> DataFrame:
    return dictionary.where(F.startswith(F.col("term"), F.lit(prefix.lower()))).orderBy(F.col("df").desc(), "term").limit(count)


def boost_recent(score: Column, age_days: Column, a: float = 1.0, b: float = 1.0) -> Column:
    """score times a / (age + b), in days."""
    return score * (a / (age_days + b))


def elevated(found: DataFrame, key: str, pinned: list, hidden: list | None = None) -> DataFrame:
    """Pinned rows first and in their order, hidden ones gone."""
    rows = found.where(~F.col(key).isin(hidden)) if hidden else found
    place = reduce(lambda c, x: c.when(F.col(key) == x[1], x[0]), enumerate(pinned), F.when(F.lit(False), 0)).otherwise(len(pinned))
    return rows.withColumn("place", place).orderBy("place", F.col("score").desc(), key)


def more_like(docs: DataFrame, key: str, value, field: str = "text", options: Options | None = None) -> DataFrame:
    """Rows like one row, by its most interesting terms."""
    options = options or Options(fields=(field,))
    terms = interesting_terms(docs.where(F.col(key) == value), field, key, options.like_terms, min_tf=1, min_df=1, against=docs)
    node = Node("bool", parts=[("should", Node("term", text=r["term"], field=field)) for r in terms.orderBy("rank").collect()])
    return search(docs.where(F.col(key) != value), node, replace(options, relevance=False))
