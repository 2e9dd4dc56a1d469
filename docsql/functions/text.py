"""Analysed text: tokens, matching and scores as Column expressions.

The analyser lower-cases a text and takes maximal runs of letters, digits and underscores (of any script).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens_of(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c.cast("string")), r"[^\p{L}\p{N}_\p{M}]+"), lambda t: t != "")


def wildcard_regex(pattern: str, sql: bool = False) -> str:
    """An anchored regular expression. sql: % and _ are wildcards too, &PERCENT and &UNDERSCORE stand for themselves."""
    if sql:
        pattern = pattern.replace("%", "*").replace("_", "?").replace("&PERCENT", "%").replace("&UNDERSCORE", "_")
    return "(?s)^" + "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern) + "$"


def needed(n: int, minimum: str | int | None, operator: str | None) -> int:
    """How many of n terms must match."""
    if (operator or "or").lower() == "and":
        return n
    if minimum is None:
        return 1
    text = str(minimum)
    k = n * int(text[:-1]) // 100 if text.endswith("%") else int(text)
    return max(1, min(n, k if k >= 0 else n + k))


def match(toks: Column, words: list[str], minimum=None, operator=None) -> Column:
    words = list(dict.fromkeys(words))
    if not words:
        return F.lit(False)
    k = needed(len(words), minimum, operator)
    wanted = F.array(*[F.lit(w) for w in words])
    return F.arrays_overlap(toks, wanted) if k == 1 else F.size(F.array_intersect(toks, wanted)) >= k


def let(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f mentions it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def phrase(toks: Column, words: list[str], slop: int = 0, prefix: bool = False) -> Column:
    """The words one after the other; with slop, in order with up to so many others between; prefix: the last word may go on."""
    if not words:
        return F.lit(False)
    if slop:
        return span_near(toks, [[w] for w in words], slop, True)
    # Tokens hold no blanks, so joined by blanks they keep their limits.
    joined = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))
    return joined.contains(" " + " ".join(words) + ("" if prefix else " "))


def span_near(toks: Column, clauses: list[list[str]], slop: int, in_order: bool) -> Column:
    """Some occurrence of each clause within a stretch of len(clauses) + slop tokens."""
    n = len(clauses)

    def places(t: Column, words: list[str]) -> Column:
        return F.filter(F.transform(t, lambda w, i: F.when(w.isin(*words), i)), lambda i: i.isNotNull())

    def pairs(spans: Column, here: Column) -> Column:
        near = lambda s: F.filter(here, lambda i: F.abs(i - s["lo"]) < n + slop)
        one = lambda s: F.transform(near(s), lambda i: F.struct(F.least(s["lo"], i).alias("lo"), F.greatest(s["hi"], i).alias("hi"), i.alias("i"), s["hi"].alias("before")))
        joined = F.flatten(F.transform(spans, one))
        fine = F.filter(joined, lambda s: (s["hi"] - s["lo"] + 1 <= n + slop) & ((s["i"] > s["before"]) if in_order else F.lit(True)))
        return F.array_distinct(F.transform(fine, lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))))

    def found(t: Column) -> Column:
        spans = F.transform(places(t, clauses[0]), lambda i: F.struct(i.alias("lo"), i.alias("hi")))
        for words in clauses[1:]:
            spans = _with(places(t, words), spans, pairs)
        return F.size(spans) > 0

    return let(toks, found)


def _with(here: Column, spans: Column, f) -> Column:
    return let(here, lambda h: let(spans, lambda s: f(s, h)))


def bm25(toks: Column, word: str, n_docs: Column, n_with: Column, mean_length: Column) -> Column:
    """The score of one word."""
    tf = F.size(F.filter(toks, lambda t: t == word)).cast("double")
    idf = F.log(1 + (n_docs - n_with + 0.5) / (n_with + 0.5))
    return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size(toks) / mean_length))).otherwise(0.0)


def highlight(c: Column, words: list[str], before: str, after: str) -> Column:
    if not words:
        return c
    pattern = r"(?iU)\b(" + "|".join(re.escape(w) for w in words) + r")\b"
    return F.regexp_replace(c, F.lit(pattern), F.lit(before.replace("$", r"\$") + "$1" + after.replace("$", r"\$")))
