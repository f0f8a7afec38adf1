"""Every code point against Python's own forms."""

import re
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from touchline.functions import names as N
from touchline.functions import unicode as U


@pytest.fixture(scope="module")
def points(spark):
    """Texts that hold every code point once, alone between letters."""
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    texts = ["a".join(every[i : i + 64]) for i in range(0, len(every), 64)] + ["", "é\x00ﬁ한", None, "ẹ́x", "ﬃ한국어ẞİ", "\x00" * 3]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(8).cache()


def python_norm(s, dash=" "):
    s = U.base_of(s).casefold()
    for c in "-'’":
        s = s.replace(c, dash)
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s)).strip()


@pytest.mark.parametrize("form, plain", [(U.without_marks, U.base_of), (U.folded, str.casefold), (N.norm, python_norm), (N.norm_tight, lambda s: python_norm(s, ""))])
def test_every_code_point(points, form, plain):
    rows = points.select("t", form(F.col("t")).alias("x")).collect()
    if form in (N.norm, N.norm_tight):  # what a letter is depends on the JVM's version of Unicode; old ones are known to all
        old = lambda t: all(unicodedata.ucd_3_2_0.category(c) != "Cn" for c in U.base_of(t or ""))
        rows = [r for r in rows if old(r["t"])]
    assert len(rows) > 500
    bad = [(r["t"], r["x"]) for r in rows if r["x"] != (None if r["t"] is None else plain(r["t"]))]
    assert not bad, [(hex(ord(a)), b) for t, x in bad[:2] for a, b in zip(t, x) if a != b][:5]
