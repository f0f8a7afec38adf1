"""Secret scans (operator 7): a trigram inverted index in front of the rules' regexes.

Native: DataFrame and SQL functions only; Python runs on the driver, on the rules alone.

* ``trigram_query`` walks a rule's parsed regex and derives a Boolean query: the trigrams that any
  match must hold, as an OR of ANDs over lower-cased text.  A rule without mandatory trigrams has
  no query and scans every text.
* ``build_index`` makes postings (trigram, doc key) for the trigrams that the rules ask for, stored
  in the shared folder.  ``candidates`` intersects them: a document passes a rule if all trigrams of
  one of its conjunctions have a posting there.
* ``scan`` runs each rule's regex on its candidates only, on whole texts.

Spans count code points, end exclusive.  A rule's matches are leftmost and non-overlapping; matches
that miss the rule's minimum length are dropped after matching.

Edge cases: null texts are empty and hold nothing; repeated and null doc_ids are fine (keys only
widen the candidates, the regex decides); extra columns pass through ``scan``.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

try:
    from re import _parser as _sre
except ImportError:  # before Python 3.11
    import sre_parse as _sre


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int  # the group whose length counts
    least: int  # characters of it
    base: bool = True


#: The base rules, then the rules that the method adds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"(AKIA[A-Z0-9]+)", 1, 16),
    Rule("hex", r"([0-9a-f]+)", 1, 32),
    Rule("github", r"(gh[pousr]_[A-Za-z0-9]+)", 1, 40, False),
    Rule("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 27, False),
)

_MANY = 64  # exact strings kept while deriving; past it, they turn into trigrams


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(regex: str) -> frozenset[frozenset[str]] | None:
    """An OR of ANDs of trigrams in lower case; None where a match may hold no trigram for sure."""

    def merge(a, b):  # AND of two queries
        if a is None or b is None:
            return a if b is None else b
        return frozenset(x | y for x in a for y in b)

    def settle(strings):
        """What the exact strings of a run demand: one conjunction each."""
        parts = [_trigrams(s) for s in strings]
        return None if not all(parts) else frozenset(parts)

    def walk(items) -> tuple[set[str] | None, frozenset | None]:
        """(all strings that the items can match, or None if open; the query of what is settled)."""
        run, query = {""}, None
        for op, arg in items:
            strings, inner = one(op, arg)
            if strings is not None and len(run) * len(strings) <= _MANY and inner is None:
                run = {a + b for a, b in itertools.product(run, strings)}
            else:
                query = merge(query, settle(run))
                query, run = merge(query, inner), strings if strings is not None and len(strings) <= _MANY else {""}
                if strings is None:
                    run = {""}
                    open_ends.append(1)
        return run, query

    open_ends: list[int] = []

    def one(op, arg):
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).lower()}, None
        if name == "IN":
            chars = set()
            for kind, what in arg:
                if str(kind) == "LITERAL":
                    chars.add(chr(what).lower())
                elif str(kind) == "RANGE" and what[1] - what[0] < 16:
                    chars |= {chr(c).lower() for c in range(what[0], what[1] + 1)}
                else:
                    return None, None
            return (chars, None) if len(chars) <= 8 else (None, None)
        if name == "SUBPATTERN":
            before = len(open_ends)
            strings, query = walk(arg[-1])
            if query is None and len(open_ends) == before:
                return strings, None
            return None, merge(query, settle(strings))
        if name == "BRANCH":
            found, whole = [], set()
            for branch in arg[1]:
                before = len(open_ends)
                strings, query = walk(branch)
                if query is None and len(open_ends) == before:
                    whole |= strings
                else:
                    found.append(merge(query, settle(strings)))
            if not found:
                return whole, None
            found += [settle({s}) for s in whole]
            return None, None if any(q is None for q in found) else frozenset().union(*found)
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, what = arg
            before = len(open_ends)
            strings, query = walk(what)
            closed = query is None and len(open_ends) == before
            if closed and (low, high) == (0, 1):
                return strings | {""}, None
            if closed and low == high and len(strings) ** low <= _MANY:
                return {"".join(p) for p in itertools.product(strings, repeat=low)}, None
            return (None, merge(query, settle(strings))) if low else (None, None)
        return None, None

    run, query = walk(list(_sre.parse(regex)))
    query = merge(query, settle(run))
    return query and frozenset(q for q in query if not any(other < q for other in query))


def queries_of(rules=RULES) -> dict[str, frozenset | None]:
    return {r.kind: trigram_query(r.regex) for r in rules}


def build_index(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, key) of the trigrams that the rules ask for; distinct, stored."""
    asked = sorted({t for q in queries_of(rules).values() if q for conj in q for t in conj})
    low = F.lower(F.col(text_col))
    held = F.filter(F.array(*[F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in asked]), lambda t: t.isNotNull())
    rows = docs.select(F.col(id_col).alias("key"), low.alias("_low")).select("key", F.explode(held).alias("trigram"))
    return stage(rows, "trigram-postings")


def candidates(postings: DataFrame, rules=RULES) -> DataFrame:
    """(key, kinds): the rules whose Boolean query the key's postings satisfy."""
    per_rule = {k: q for k, q in queries_of(rules).items() if q}
    asked = sorted({t for q in per_rule.values() for conj in q for t in conj})
    bit = {t: i for i, t in enumerate(asked)}
    if len(asked) > 63:
        raise ValueError("over 63 trigrams: give the rules in several scans")
    value = F.element_at(F.create_map(*[F.lit(x) for t in asked for x in (t, 1 << bit[t])]), F.col("trigram")).cast("long")
    held = postings.groupBy("key").agg(F.bit_or(value).alias("held"))

    def passes(query) -> Column:
        masks = [sum(1 << bit[t] for t in conj) for conj in query]
        ok = F.lit(False)
        for m in masks:
            ok = ok | (F.col("held").bitwiseAND(F.lit(m).cast("long")) == F.lit(m).cast("long"))
        return ok

    kinds = F.filter(F.array(*[F.when(passes(q), F.lit(k)) for k, q in per_rule.items()]), lambda k: k.isNotNull())
    return held.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, kind number, end) of a rule's matches that are long enough.

    The pieces between matches and the matches themselves add up to the places."""
    rx = F.lit(rule.regex)
    gaps = F.transform(F.split(text, rule.regex, -1), F.length)
    hits = F.arrays_zip(gaps.alias("gap"), F.transform(F.regexp_extract_all(text, rx, F.lit(0)), F.length).alias("len"), F.transform(F.regexp_extract_all(text, rx, F.lit(rule.group)), F.length).alias("val"))
    kept = "array<struct<start:int,no:int,end:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kept).alias("out"))

    def step(acc, x):
        start = acc["at"] + F.coalesce(x["gap"], F.lit(0))
        end = start + F.coalesce(x["len"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("no"), end.alias("end")))
        good = x["val"].isNotNull() & (x["val"] >= rule.least)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.when(good, span).otherwise(F.array().cast(kept))).alias("out"))

    found = F.aggregate(hits, zero, step, lambda acc: acc["out"])
    return F.when(F.regexp_count(text, rx) > 0, found).otherwise(F.array().cast(kept)) if rule.kind != "hex" else F.when(text.rlike(f"[0-9a-f]{{{rule.least}}}"), found).otherwise(F.array().cast(kept))


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: all spans (start, no, end), ``no`` the rule's place in ``rules``."""
    queries = queries_of(rules)
    found = candidates(build_index(docs, rules, id_col, text_col), rules)
    found = stage(found.select(F.col("key").alias("_key"), F.col("kinds").alias("_kinds")), "secret-candidates")
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col("_key")), "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<start:int,no:int,end:int>>")
    spans = [
        _spans(text, r, i) if queries[r.kind] is None else F.when(F.array_contains("_kinds", r.kind), _spans(text, r, i)).otherwise(none) for i, r in enumerate(rules)
    ]
    return joined.select(*docs.columns, F.array_sort(F.concat(*spans)).alias("secrets"))


def span_text(spans: Column, rules=RULES) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans, all spans."""
    base = [i for i, r in enumerate(rules) if r.base]
    out = scan(docs.select("doc_id", "text"), rules).select("doc_id", "secrets")
    count = lambda i: F.size(F.filter("secrets", lambda s: s["no"] == i)).cast("long")
    return out.select(
        "doc_id",
        *[count(i).alias(f"n_{rules[i].kind}") for i in base],
        F.sha2(span_text(F.filter("secrets", lambda s: s["no"] <= max(base)), rules), 256).alias("base_sha256"),
        span_text(F.col("secrets"), rules).alias("spans"),
    )


