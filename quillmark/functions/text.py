"""Tokens, shingles, accents, stop words, plural stems and synonyms."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The common English stop words, and those that the click tools add.
ENGLISH_STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")
CLICK_STOP_WORDS = ENGLISH_STOP_WORDS + ("he", "how", "she", "i", "s", "what", "my", "me", "new", "you", "do", "up", "from", "www", "com", "aol", "google", "yahoo", "msn", "http", "ebay", "free", "click", "like")


def log_tokens(query: Column) -> Column:
    """Terms of a logged query: cut at spaces, quotes, commas, brackets and stars."""
    return F.filter(F.split(query, r'[ ",()*]+'), lambda x: x != "")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by a space."""
    last = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    out = F.slice(tokens, 1, last)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(tokens, k + 1, last), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def shingles(tokens: Column, largest: int = 2, stop_words: tuple[str, ...] = CLICK_STOP_WORDS) -> Column:
    """Distinct runs of 2 to largest tokens that hold a word that is no stop word."""
    stop = F.array(*[F.lit(x) for x in stop_words])
    every = F.concat(*[ngrams(tokens, n) for n in range(2, max(2, largest) + 1)])
    return F.array_distinct(F.filter(every, lambda s: F.exists(F.split(s, " "), lambda w: ~F.array_contains(stop, w))))


def _accents() -> tuple[str, str]:
    """Letters whose decomposition is one ASCII letter and marks, from the Latin blocks, and those letters."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for i in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_accents(text: Column) -> Column:
    return F.translate(text, *_accents())


def without_stop_words(tokens: Column, stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS) -> Column:
    return F.filter(tokens, lambda x: ~x.isin(*stop_words))


def without_wildcards(text: Column) -> Column:
    return F.regexp_replace(text, r"[*?]", "")


class StemRules:
    """Plural-stem rules, one on a line; the first that matches a token decides.

    word                protected word          word -> new       replacement
    *ss                 protected suffix        *?ies -> y        suffix replaced
    Each ? asks for one more character before the suffix, a trailing / on the left side of the suffix for
    a consonant before it. ! starts a comment. =, =>, ->, --> and ==> are alike.
    """

    def __init__(self, text: str):
        self.rules: list[tuple[bool, int, bool, str, str | None]] = []
        for line in text.splitlines():
            line = re.sub(r"\s+", "", line.split("!")[0])
            if not line:
                continue
            left, *right = re.split(r"-*->|=*=>|=", line, maxsplit=1)
            new = right[0] if right else None
            suffix = left.startswith("*") or left.startswith("?")
            body = left.lstrip("*")
            least = len(body) - len(body.lstrip("?"))
            body = body.lstrip("?")
            consonant = body.startswith("/") or body.endswith("/")
            self.rules.append((suffix, least, consonant, body.strip("/").lower(), new.lower() if new is not None else None))

    def column(self, token: Column) -> Column:
        """The stem of a token, as one chain of conditions."""
        low, out = F.lower(token), None
        for suffix, least, consonant, body, new in self.rules:
            before = F.substring(low, 1, F.length(low) - len(body)) if body else low
            if suffix:
                head = (r"^.{%d,}" % least) if not consonant else r"^.{%d,}[^aeiou]" % max(0, least - 1)
                hit, value = low.rlike(head + re.escape(body) + "$"), token if new is None else F.concat(before, F.lit(new.lstrip("*?/")))
            else:
                hit, value = low == body, token if new is None else F.lit(new)
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return token if out is None else out.otherwise(token)


#: Our own default rules for English plurals.
PLURALS = StemRules("""
*ss
*us
*is
alias
men -> man
women -> woman
children -> child
*??ies -> y
*?xes -> x
*?ches -> ch
*?shes -> sh
*sses -> ss
*??s -> *
""")


class Synonyms:
    """Rules 'a, b => c' (replacement) and 'a, b, c' (expansion); the longest phrase at a place wins."""

    def __init__(self, text: str):
        self.table: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
        for line in text.splitlines():
            line = line.split("#")[0].strip().lower()
            if not line:
                continue
            left, _, right = line.partition("=>")
            sources = [tuple(x.split()) for x in left.split(",") if x.strip()]
            for s in sources:
                self.table[s] = [tuple(x.split()) for x in right.split(",") if x.strip()] if right else sources
        self.longest = max(map(len, self.table), default=0)

    def lookup(self, tokens: list[str]) -> list[list[tuple[str, ...]]]:
        """Alternatives at each place of the tokens."""
        out, i = [], 0
        while i < len(tokens):
            for n in range(min(self.longest, len(tokens) - i), 0, -1):
                if (found := self.table.get(tuple(x.lower() for x in tokens[i : i + n]))) is not None:
                    out.append(found)
                    i += n
                    break
            else:
                out.append([(tokens[i],)])
                i += 1
        return out
