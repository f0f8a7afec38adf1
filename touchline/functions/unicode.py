"""Full Unicode forms of text as expressions (F8, F9): compatibility letters without marks, and full case folding.

Both forms map each code point for itself, so a text's form is that of its code points one after the other.  The
map is made from Python's own Unicode data.  Code points that become one other or none are a ``translate`` (a hash
look-up); those that become several are rare and are only looked for in texts that hold one.  Hangul syllables are
taken apart by arithmetic.  Nulls stay null; the result is what Python gives, for every code point.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the Unicode standard: the first syllable, the numbers of leading, vowel and trailing parts.
SYLLABLE, LEADS, VOWELS, TRAILS = 0xAC00, 19, 21, 28
_LEAD = "".join(chr(0x1100 + i) for i in range(LEADS))
_VOWEL = "".join(chr(0x1161 + i) for i in range(VOWELS))
_TRAIL = "".join(chr(0x11A8 + i) for i in range(TRAILS - 1))
_LAST = SYLLABLE + LEADS * VOWELS * TRAILS - 1


def base_of(text: str) -> str:
    """The compatibility decomposition without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@cache
def _table(form: Callable[[str], str]) -> tuple[str, str, dict[str, str]]:
    """Code points that become one other, then those that vanish; what the former become; those that become several."""
    changed = {c: form(c) for c in map(chr, range(sys.maxunicode + 1)) if not ("\ud800" <= c <= "\udfff" or chr(SYLLABLE) <= c <= chr(_LAST)) and form(c) != c}
    one = {c: x for c, x in changed.items() if len(x) == 1}
    return "".join([*one, *(c for c, x in changed.items() if not x)]), "".join(one.values()), {c: x for c, x in changed.items() if len(x) > 1}


def _hangul(ch: Column) -> Column:
    at = F.ascii(ch) - SYLLABLE
    pick = lambda parts, i: F.substring(F.lit(parts), i.cast("int"), F.lit(1))
    trail = at % TRAILS
    return F.concat(pick(_LEAD, F.floor(at / (VOWELS * TRAILS)) + 1), pick(_VOWEL, F.floor(at % (VOWELS * TRAILS) / TRAILS) + 1), F.when(trail == 0, "").otherwise(pick(_TRAIL, trail)))


def _class(chars) -> str:
    """A regex class of code points, in ranges."""
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


def _once(text: Column, form: Callable[[Column], Column]) -> Column:
    """``form`` of a text that is worked out once, however often the form names it: as the variable of a function
    over an array of one, so that forms of forms don't multiply."""
    return F.get(F.transform(F.array(text), form), F.lit(0))


def _mapped(text: Column, form: Callable[[str], str]) -> Column:
    """``text`` with the code points that become several replaced."""
    several = _table(form)[2]
    rare = _class(several)
    wide = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # of a literal: folded to one
    each = lambda c: F.coalesce(F.try_element_at(wide, c), c)
    # only the rare code points are looked up: each is made a piece of its own, by a mark that the text doesn't hold
    pieces = lambda x: F.split(F.regexp_replace(x, f"({rare})", "\x00$1\x00"), "\x00")
    marked = lambda x: F.transform(pieces(x), lambda p: F.when(F.length(p) == 1, each(p)).otherwise(p))
    plain = lambda x: F.transform(F.split(x, ""), each)
    return _once(text, lambda x: F.when(x.rlike(rare), F.array_join(F.when(F.contains(x, F.lit("\x00")), plain(x)).otherwise(marked(x)), "")).otherwise(x))


def without_marks(text: Column) -> Column:
    """F8 for every script: the compatibility decomposition without combining marks."""
    syllable = f"[\\x{{{SYLLABLE:x}}}-\\x{{{_LAST:x}}}]"
    apart = lambda x: F.transform(F.split(x, ""), lambda c: F.when(c.rlike(f"^{syllable}"), _hangul(c)).otherwise(c))
    out = _once(_mapped(text, base_of), lambda x: F.when(x.rlike(syllable), F.array_join(apart(x), "")).otherwise(x))
    return F.translate(out, *_table(base_of)[:2])


def folded(text: Column) -> Column:
    """Full case folding, as Python's ``str.casefold``."""
    return F.translate(_mapped(text, str.casefold), *_table(str.casefold)[:2])
