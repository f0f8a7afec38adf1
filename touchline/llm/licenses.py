"""License scans (operator 12): notices and identifier tags in whole texts, and what they oblige to.

Two Aho-Corasick automata run over each text: one over its words (``mit license``, whatever stands between
the words), one over its lower-cased characters for identifier tags (``SPDX-License-Identifier:``).  What
follows a tag is read as a licence expression: a shunting-yard parser puts identifiers, ``and``, ``or``,
``with`` and parentheses into postfix order, and the evaluation gives the licences that take effect and how
strict they are.  ``and`` obliges to both sides; ``or`` lets the user choose, so the milder side counts
and of two equally mild ones both are named; ``with`` adds an exception, which makes a copyleft licence
one step milder.  ``with`` binds closer than ``and``, ``and`` closer than ``or``.

Bytes are enough: words and tags are delimited by ASCII, and a place is a word's number or a byte's.

Edge cases: null and empty texts hold nothing (no words, score 0); an expression ends where it can't go on;
one that can't be read has no licence but its tag still scores; unknown identifiers are labelled ``other``;
repeated rows are scanned each; extra columns pass through ``scan``, whose new column must be a new name;
long texts are scanned whole, in batches of few rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import text_batches

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrases that the method adds.
OWN = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}
TAGS = ("spdx-license-identifier:", "license-identifier:", "license-expression:")
#: Beginnings of licence identifiers, the longest that fits counts: label and strictness.
IDENTIFIERS = {
    "mit": ("mit", 0), "isc": ("isc", 0), "zlib": ("zlib", 0), "unlicense": ("public-domain", 0), "0bsd": ("bsd", 0), "bsd-": ("bsd", 0),
    "apache-": ("apache", 0), "cc0-": ("cc0", 0), "cc-by-": ("cc-by", 0), "cc-by-sa-": ("cc-by-sa", 2), "cc-by-nc-": ("cc-by-nc", 3), "cc-by-nd-": ("cc-by-nd", 3),
    "mpl-": ("mpl", 1), "epl-": ("epl", 1), "lgpl-": ("lgpl", 1), "gpl-": ("gpl", 2), "agpl-": ("agpl", 3),
}
#: By strictness; an unknown identifier is as strict as can be.
CLASSES = ("permissive", "weak-copyleft", "copyleft", "restricted")
#: How sure a finding is that the text carries a licence: a tag with an expression that can be read, one with
#: an unknown identifier, one that can't be read; a phrase of three words or more, a shorter one.
SURE = {"tag": 0.99, "unknown": 0.8, "broken": 0.5, "phrase": 0.9, "short": 0.6}
BINDS = {"or": 1, "and": 2, "with": 3}

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TOKEN = re.compile(rb"[ \t]*(?:([()])|([a-z0-9]+(?:[.:_-][a-z0-9]+)*\+?))")
_KINDS = {"base": T.BooleanType(), "label": T.StringType(), "word": T.LongType(), "byte": T.LongType(), "sure": T.DoubleType(), "expression": T.StringType(), "class": T.StringType()}
FINDING = T.StructType([T.StructField(n, kind) for n, kind in _KINDS.items()])
ROW = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("found", T.ArrayType(FINDING))])


@dataclass(frozen=True)
class Terms:
    """What an expression obliges to: labels of the licences that take effect, and their strictness."""

    labels: frozenset[str]
    strict: int
    known: bool = True


def operand(name: str) -> Terms:
    plain = name[:-1] if name.endswith("+") else name
    fits = [k for k in IDENTIFIERS if plain == k or (k.endswith("-") and plain.startswith(k))]
    if not fits:
        return Terms(frozenset({"other"}), len(CLASSES) - 1, False)
    label, strict = IDENTIFIERS[max(fits, key=len)]
    return Terms(frozenset({label}), strict)


def postfix(tokens: Iterable[str]) -> list[str]:
    """Shunting yard: postfix order of the longest prefix of ``tokens`` that is an expression; empty if none is.

    Reads no further than the expression goes on."""
    out: list[str] = []
    held: list[str] = []
    whole: tuple[int, list[str]] = (0, [])  # what is complete: so many of ``out``, then these
    depth, operand_next = 0, True
    for token in tokens:
        if token == "(" and operand_next:
            held.append(token)
            depth += 1
        elif token == ")" and not operand_next and depth:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        elif token in BINDS and not operand_next:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[token]:
                out.append(held.pop())
            held.append(token)
            operand_next = True
        elif operand_next and token not in BINDS and token not in "()":
            out.append(token)
            operand_next = False
        else:
            break
        if not operand_next and not depth:
            whole = (len(out), held[::-1])  # three operators at most
    return out[: whole[0]] + whole[1]


def evaluate(order: list[str]) -> Terms | None:
    """The value of a postfix expression; None for none."""
    stack: list[Terms | str] = []
    value = lambda x: operand(x) if isinstance(x, str) else x
    for token in order:
        if token not in BINDS:
            stack.append(token)
            continue
        right, left = stack.pop(), value(stack.pop())
        if token == "with":  # the right side names an exception, no licence
            strict = left.strict - 1 if left.strict in (1, 2) else left.strict
            stack.append(Terms(left.labels, strict, left.known))
            continue
        right = value(right)
        if token == "and":
            stack.append(Terms(left.labels | right.labels, max(left.strict, right.strict), left.known and right.known))
        elif left.strict == right.strict:
            stack.append(Terms(left.labels | right.labels, left.strict, left.known and right.known))
        else:
            stack.append(min(left, right, key=lambda t: t.strict))
    return value(stack.pop()) if stack else None


def expression_tokens(low: bytes, at: int) -> Iterator[str]:
    """Tokens from ``at`` on, up to the line's end or what is none."""
    while hit := _TOKEN.match(low, at):
        yield (hit[1] or hit[2]).decode()
        at = hit.end()


def _automaton(patterns):
    import ahocorasick

    made = ahocorasick.Automaton()
    for text, value in patterns:
        made.add_word(text, value)
    made.make_automaton()
    return made


class Scanner:
    """Findings of a text; made once for each task."""

    def __init__(self, own: dict[str, str] = OWN):
        both = [(p, label, True) for p, label in BASE.items()] + [(p, label, False) for p, label in own.items()]
        self.phrases = _automaton((f" {p} ", (p.count(" ") + 1, base, label, p)) for p, label, base in both)
        self.tags = _automaton((t, t) for t in TAGS)

    def __call__(self, text: bytes | None) -> tuple[int, list[tuple]]:
        """(words, findings): base, label, word, byte, sure, expression, class."""
        if not text:
            return 0, []
        words = text.translate(_FOLD).split()
        flat, found = (b" " + b" ".join(words) + b" ").decode("latin-1"), []
        at = seen = 0  # a place in ``flat``, and the number of the word there
        for end, (size, base, label, phrase) in self.phrases.iter(flat) if words else ():
            start = end - 1 - len(phrase)
            seen, at = seen + flat.count(" ", at, start) - flat.count(" ", start, at), start
            found.append((base, label, seen, None, SURE["phrase" if size > 2 else "short"], None, None))
        low = text.lower()
        last = 0
        for end, tag in self.tags.iter(low.decode("latin-1")):
            if end < last:  # the end of a longer tag is one of its own
                continue
            last = end + 1
            order = postfix(expression_tokens(low, end + 1))
            terms = evaluate(order)
            where = end + 1 - len(tag)
            if terms is None:
                found.append((False, "unread", None, where, SURE["broken"], None, None))
                continue
            sure, kind = SURE["tag" if terms.known else "unknown"], CLASSES[terms.strict]
            for label in sorted(terms.labels):
                found.append((False, label, None, where, sure, " ".join(order), kind))
        return len(words), found


def scan(docs: DataFrame, text_col: str = "text", out: str = "licences", own: dict[str, str] = OWN) -> DataFrame:
    """``docs`` with ``out``: the number of words and all findings, in the order of phrases by word, then tags."""
    if out in docs.columns:
        raise ValueError(f"the table has a column {out}")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, ROW)])

    def run(batches):
        find = Scanner(own)
        kind = to_arrow_type(ROW)
        for batch in batches:
            rows = []
            for text in batch.column(at).cast(pa.binary()):
                n, found = find(text.as_py())
                rows.append({"n_words": n, "found": [dict(zip(_KINDS, f)) for f in found]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, out])

    at = docs.columns.index(text_col)
    return text_batches(docs).mapInArrow(run, schema)


def license_digest(docs: DataFrame, own: dict[str, str] = OWN) -> DataFrame:
    """doc_id, words, base places, the first and last of them, labels, and how sure the text carries a licence:
    one minus the chance that each of its labels is wrong, a label counted once, by its surest finding."""
    found = scan(docs.select("doc_id", "text"), own=own)
    base = F.filter("licences.found", lambda x: x["base"])
    names = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    every = F.transform("licences.found", lambda x: F.struct(x["label"].alias("label"), x["sure"].alias("sure")))
    best = lambda label: F.array_max(F.transform(F.filter(every, lambda x: x["label"] == label), lambda x: x["sure"]))
    labels = F.array_sort(F.array_distinct(F.transform(every, lambda x: x["label"])))
    missed = F.aggregate(labels, F.lit(1.0), lambda acc, label: acc * (1.0 - best(label)))
    kinds = F.transform(F.filter("licences.found", lambda x: x["class"].isNotNull()), lambda x: x["class"])
    all_labels = F.array_join(F.array_sort(F.array_distinct(F.concat(labels, kinds))), ",")
    word = lambda pick: pick(F.transform(base, lambda x: x["word"]))
    return found.select(
        "doc_id",
        F.col("licences.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        word(F.array_min).alias("first_word"),
        word(F.array_max).alias("last_word"),
        names(base).alias("base_labels"),
        all_labels.alias("labels"),
        (1.0 - missed).alias("score"),
    )
