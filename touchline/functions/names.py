"""Names: accents, normal forms, tokens, case (F8-F13), JVM-side.

Accents and case: ``unicode`` has the full forms of every script, which the normal forms use; the letters
that NFKD takes apart in the Latin blocks are also a map of their own, short enough for SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import unicode as U


_LATIN = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(U.base_of(chr(c))) == 1 and U.base_of(chr(c)) != chr(c)]
_FROM, _TO = "".join(_LATIN), "".join(map(U.base_of, _LATIN))
_MARKS = "[̀-ͯ]"
DASHES = "['’-]"
OTHER = r"[^\p{L}\p{N}_\s]"


def strip_accents(text: Column) -> Column:
    """F8: Latin letters without their marks, combining marks dropped."""
    return F.regexp_replace(F.translate(text, _FROM, _TO), _MARKS, "")


def nfkd_accents(text: Column) -> Column:
    """F8 for every script."""
    return U.without_marks(text)


def plain(text: Column) -> Column:
    """No accents, folded case: what both normal forms start from."""
    return U.folded(U.without_marks(text))


def norm_of(plain_text: Column, dash: str = " ") -> Column:
    """The normal form of a text that ``plain`` gave; ``dash`` is what hyphens and apostrophes become."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain_text, DASHES, dash), OTHER, " "), r"\s+", " "))


def norm(text: Column) -> Column:
    """no accents, folded case, punctuation as blanks."""
    return norm_of(plain(text))


def norm_tight(text: Column) -> Column:
    """like ``norm``, but hyphens and apostrophes vanish."""
    return norm_of(plain(text), "")


#: ``norm`` as SQL over ``x``, for the registered function.
SQL_NORM = (
    f"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(translate(x, '{_FROM}', '{_TO}')), 'ß', 'ss'), "
    f"'[\\'’-]', ' '), '[^\\\\p{{L}}\\\\p{{N}}_\\\\s]', ' '), '\\\\s+', ' '))"
)


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda t: t != "")


def first_last(normal: Column) -> tuple[Column, Column]:
    """first and last token; null under two tokens."""
    t = tokens(normal)
    two = F.size(t) >= 2
    return F.when(two, F.try_element_at(t, F.lit(1))), F.when(two, F.try_element_at(t, F.lit(-1)))


def split_name(text: Column) -> tuple[Column, Column]:
    """(first, last): tokens all in capitals are the family name, wherever they stand."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    letters = lambda t: F.regexp_replace(t, r"[^\p{L}]", "")
    upper = lambda t: (letters(t) != "") & (F.upper(letters(t)) == letters(t))
    last = F.array_join(F.filter(parts, upper), " ")
    first = F.array_join(F.filter(parts, lambda t: ~upper(t)), " ")
    return first, last


def title_case(text: Column) -> Column:
    """each word and each part of a hyphenated word begins with a capital."""
    part = lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, F.lit(2), F.length(p))))
    word = lambda w: F.array_join(F.transform(F.split(w, "-"), part), "-")
    return F.array_join(F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""), word), " ")


def full_name(first: Column, last: Column) -> Column:
    return title_case(F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(last, F.lit(""))))
