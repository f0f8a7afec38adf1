"""Operators 11 to 13 against brute force and on edge cases; their SQL is held against them in test_operators."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from oracle import connect, same_rows
from touchline.llm import conversations, divergence, licenses, queries

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, term string, place long, counts string, n_words long"


def table(spark, rows):
    """Rows (doc_id, text, lang, source) with columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "t", 0, "c", 0) for r in rows], DOC)


# -- operator 11 -----------------------------------------------------------------------------------
def divergence_brute(rows, least=10, top=10):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, count = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = term.findall((text or "").translate(low))
        count[lang or "", source or ""].update(words)
        held[lang or ""].update(set(words))
    out = set()
    for lang in {g[0] for g in count}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        groups = {s: c for (g, s), c in count.items() if g == lang}

        def shares(c):
            whole = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // whole for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(c) for s, c in groups.items()}, shares(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(ordered, 1)}
    return out


def test_divergence_brute(spark):
    rnd = random.Random(5)
    words = [f"{a}{b}" for a in "abcdeéß日" for b in ("", "x", "Ü", "Q")]
    rows = [(i, " ".join(rnd.choice(words) + rnd.choice(("", ".", "1", "_")) for _ in range(rnd.randint(0, 40))), rnd.choice(("en", "de", None)), rnd.choice(("a", "b", "é", "", None, "日"))) for i in range(150)]
    rows += [(None, None, "fr", "only"), (1, "few words here", "it", "x"), (1, "few words here", "it", "y"), (2, "", "it", None), (3, " ".join(words * 500), "en", "a"), (4, "one two", "en", "late")]
    rows += [(9, "Same words again", "en", "copy")] * 12
    got = [tuple(r) for r in divergence.divergence(table(spark, rows)).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == divergence_brute(rows)
    got = {tuple(r) for r in divergence.divergence(table(spark, rows), least_docs=2, top=3).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == divergence_brute(rows, 2, 3)


def test_divergence_empty(spark):
    assert divergence.divergence(table(spark, [])).count() == 0


def test_shares_are_exact(spark):
    cases = [(0, 2), (1, 10**15), (10**15, 3 * 10**15 + 7), (8 * 10**15, 9 * 10**15), (5, 7), (10**14, 10**14 + 2)]
    df = spark.createDataFrame(cases, "c long, w long")
    for r in df.select("c", "w", divergence.share(F.col("c"), F.col("w")).alias("p")).collect():
        assert r["p"] == 1 + 10**9 * (r["c"] + 2) // r["w"]


# -- operator 12 -----------------------------------------------------------------------------------
def licence_base(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
    places = sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + phrase.count(" ") + 1] == phrase.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({label for _, label in places}))


TEXTS = [
    None, "", "  \n", "Released under the MIT License.", "mit-license MIT/License mit1license mité license mit licenses", "CC BY-NC 4.0, cc  by. CC-BY-SA", "GNU General Public License, version 3; GNU Lesser General Public License",
    "Apache\nLicense apache license APACHE LICENSE", "cc cc by by cc by", "日本 MIT License 日本", "İ MIT LİCENSE mit license", "mit license " * 20000, "gnu general public licence", "x" * 200000 + " mit license",
]


def test_licences_brute(spark):
    rnd = random.Random(11)
    bits = ["MIT", "license", "License.", "cc", "BY", "by-", "gnu", "general", "public", "apache", "sa", "é", "\n", "x1"]
    texts = TEXTS + [" ".join(rnd.choice(bits) for _ in range(rnd.randint(1, 60))) for _ in range(200)]
    rows = [(i if i % 7 else None, t, "en", "s") for i, t in enumerate(texts)] + [(3, TEXTS[3], "en", "s")]
    got = licenses.license_digest(table(spark, rows)).collect()
    assert got and got[0].asDict().keys() == dict.fromkeys(["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]).keys()
    assert Counter((r["doc_id"], *tuple(r)[1:6]) for r in got) == Counter((i, *licence_base(t)) for i, t, _, _ in rows)
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) for r in got)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)


def test_licences_on_tables(spark):
    sql = r"""
    with w as (select doc_id, ' ' || array_to_string(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), ' ') || ' ' t from documents)
    select doc_id, (len(regexp_extract_all(t, '[^ ]+')))::bigint n_words, (len(string_split(t, ' gnu general public license ')) + len(string_split(t, ' apache license ')) + len(string_split(t, ' cc by ')) + len(string_split(t, ' mit license ')) - 4)::bigint n_base from w"""
    assert same_rows(queries.QUERIES["op12_licenses"](spark, SF).select("doc_id", "n_words", "n_base"), sql, connect(SF)) == 200


def plain_value(expression):
    """The value of an expression by splitting at the weakest operator outside parentheses."""
    tokens = re.findall(r"[()]|[^\s()]+", expression)

    def value(ts):
        depth, cut = 0, None
        for i, t in enumerate(ts):
            depth += (t == "(") - (t == ")")
            if t in licenses.BINDS and not depth and (cut is None or licenses.BINDS[t] <= licenses.BINDS[ts[cut]]):
                cut = i
        if cut is None:
            return value(ts[1:-1]) if ts[0] == "(" else licenses.operand(ts[0])
        a = value(ts[:cut])
        if ts[cut] == "with":
            return licenses.Terms(a.labels, a.strict - (a.strict in (1, 2)), a.known)
        b = value(ts[cut + 1 :])
        if ts[cut] == "and":
            return licenses.Terms(a.labels | b.labels, max(a.strict, b.strict), a.known and b.known)
        if a.strict != b.strict:
            return min(a, b, key=lambda x: x.strict)
        return licenses.Terms(a.labels | b.labels, a.strict, a.known and b.known)

    return value(tokens)


def test_expressions():
    rnd = random.Random(2)
    ids = ["mit", "apache-2.0", "gpl-2.0-only", "lgpl-2.1+", "agpl-3.0", "cc-by-sa-4.0", "mpl-2.0", "odd-1"]

    def make(depth):
        kind = rnd.choice(("id", "and", "or", "with", "paren")) if depth else "id"
        if kind == "id":
            return rnd.choice(ids)
        if kind == "with":
            return f"{rnd.choice(ids)} with classpath-exception-2.0"
        return f"({make(depth - 1)})" if kind == "paren" else f"{make(depth - 1)} {kind} {make(depth - 1)}"

    for _ in range(2000):
        e = make(4)
        tokens = list(licenses.expression_tokens(e.encode(), 0))
        assert "".join(tokens) == e.replace(" ", "")
        assert licenses.evaluate(licenses.postfix(tokens)) == plain_value(e), e
    assert licenses.postfix("mit or".split()) == ["mit"] and licenses.postfix("( mit".split()) == [] == licenses.postfix(["and", "mit"])
    assert licenses.postfix(["mit", "mit"]) == ["mit"] and licenses.postfix(["(", "a", "or", "b", ")", ")"]) == ["a", "b", "or"]


@pytest.mark.parametrize(
    "text, labels",
    [
        ("// SPDX-License-Identifier: MIT OR GPL-2.0-only\n and more", "mit,permissive"),
        ("# SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND MIT */", "gpl,mit,weak-copyleft"),
        ("spdx-license-identifier: Odd-7.", "other,restricted"),
        ("License-Expression: LGPL-2.1+ OR MPL-2.0. The text goes on", "lgpl,mpl,weak-copyleft"),
        ("SPDX-License-Identifier:", "unread"),
        ("SPDX-License-Identifier: and", "unread"),
        ("all rights reserved", "reserved"),
    ],
)
def test_tags(spark, text, labels):
    r = licenses.license_digest(table(spark, [(1, text, None, None)])).first()
    assert r["labels"] == labels and r["base_labels"] == "" and 0 < r["score"] < 1


def test_scan_keeps_columns(spark):
    df = table(spark, [(1, "mit license", "en", "s"), (None, None, None, None)])
    out = licenses.scan(df)
    assert out.columns == [*df.columns, "licences"] and out.select(df.columns).exceptAll(df).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(df, out="place")
    assert licenses.license_digest(table(spark, [])).count() == 0


# -- operator 13 -----------------------------------------------------------------------------------
def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def fault_of(text, again):
    if not re.search(r"[^\x20\x09-\x0D]", text):
        return 1
    return 2 if again else 0 if text.rstrip(" \t\n\v\f\r")[-1] in ".!?" else 3


def facts_and_turns(turns):
    turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, marked = set(), []
    for _, turn, role, text in turns:
        marked.append((turn, role, text, fault_of(text, (role, text) in seen)))
        seen.add((role, text))
    numbers = [t for t, *_ in marked if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
    return marked, (gaps, *[sum(m[3] == k for m in marked) for k in (1, 2, 3)], illegal)


def cheapest(marked):
    """The least (cost, audit, text) over all edits, with up to two insertions between turns."""
    best = []

    def go(k, roles, cost, audit, text, room):
        if best and cost > best[0][0] or not re.fullmatch("s?(ua)*u?", roles):  # nothing that follows mends the roles
            return
        if room:
            for r in ("user", "assistant"):
                go(k, roles + r[0], cost + 2, audit + "I", [*text, f"{r}:"], room - 1)
        if k == len(marked):
            if re.fullmatch("(s?(ua)+)?", roles):
                best[:] = [min([*best, (cost, audit, text)], key=lambda x: x[:2])]
            return
        _, role, body, fault = marked[k]
        go(k + 1, roles, cost + 3, audit + "D", text, 2)
        if fault in (1, 2):
            return
        more = fault == 3
        go(k + 1, roles + (role[:1] or "?"), cost + more, audit + "K", [*text, f"{role}:{body}"], 2)
        for r in ("user", "assistant"):
            go(k + 1, roles + r[0], cost + 2 + more, audit + "R", [*text, f"{r}:{body}"], 2)

    go(0, "", 0, "", [], 2)
    cost, audit, text = best[0]
    return cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()


CONV = "conv_id long, turn long, role string, text string, fault int, gone int, again int"


def test_repair_brute(spark):
    rnd = random.Random(8)
    rows = []
    for conv in [None, *range(150)]:
        for k in range(rnd.randint(0, 5)):
            turn = rnd.choice((None, k, k, k, k + 2))
            rows.append((conv, turn, rnd.choice(("system", "user", "assistant", "user", "assistant", "tool", "", None)), rnd.choice(("Yes.", "No!", "broken off", "", " \n", None, "é?", "dot. \t", "line ", "Well then."))))
    out = conversations.repair_damaged(spark.createDataFrame([(*r, 0, 0, 0) for r in rows], CONV))
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    by = defaultdict(list)
    for r in damaged(rows):
        by[r[0]].append(r)
    assert got.keys() == {r[0] for r in rows} and out.count() == len(got)
    for conv, mine in got.items():
        marked, facts = facts_and_turns(by[conv])
        assert mine == (*facts, *cheapest(marked)), (conv, marked)


def plain_viterbi(marked):
    """All four states with whole audits and texts, without setting aside or leaving out any."""
    after = conversations.AFTER
    ways = {0: (0, "", ())}

    def close(w):
        for to, frm in ((2, (0, 1, 3)), (3, (2,)), (2, (3,))):
            for s in frm:
                if s in w:
                    c, a, t = w[s]
                    w[to] = min(w.get(to, (1e9, "", ())), (c + 2, a + "I", (*t, conversations.ROLES[to] + ":")))
        return w

    ways = close(ways)
    for _, role, text, fault in marked:
        new = {}
        for s, (c, a, t) in ways.items():
            new[s] = min(new.get(s, (1e9, "", ())), (c + 3, a + "D", t))
            if fault in (1, 2):
                continue
            tries = [("K", 0, after.get(role[:1], {}).get(s), role)] + [("R", 2, after[r[0]].get(s), r) for r in ("user", "assistant")]
            for edit, cost, to, name in tries:
                if to is not None:
                    new[to] = min(new.get(to, (1e9, "", ())), (c + cost + (fault == 3), a + edit, (*t, f"{name}:{text}")))
        ways = close(new)
    cost, audit, text = min(ways[s] for s in (0, 3) if s in ways)
    return cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(4))
def test_long_conversations(seed):
    rnd = random.Random(seed)
    roles = ("user", "assistant") if seed < 2 else ("user", "assistant", "system", "x")
    marked = [(k, roles[k % 2] if seed == 0 else rnd.choice(roles), f"t{k}.", rnd.choice((0, 0, 0, 3, 2, 1))) for k in range(1500)]
    held = conversations.Repair()
    for m in marked:
        held.add(*m)
    assert held.result()[5:] == plain_viterbi(marked)
    assert max(len(w.audit) for w in held.ways if w) < 600  # what the ways share is set aside


def test_repair_streams_a_hot_conversation(spark):
    rows = spark.range(20000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id"), F.lit(".")).alias("text"))
    r = conversations.repair(rows.withColumn("gone", F.lit(False))).first()
    assert (r["cost"], r["audit"], r["gaps"], r["illegal"]) == (0, "K" * 20000, 0, 0)


def test_repair_empty(spark):
    assert conversations.repair_damaged(spark.createDataFrame([], CONV)).count() == 0
    gone = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    r = conversations.repair_damaged(spark.createDataFrame([(gone, 0, "user", "x", 0, 0, 0)], CONV)).first()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
