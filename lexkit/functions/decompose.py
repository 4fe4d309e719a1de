"""canonical decomposition (NFD) as JVM-side column expressions.

Spark SQL has no normalisation function.  The tables come from Python's Unicode
database when a plan is built (canonical decompositions and combining classes
are stable between Unicode versions); the rows never leave the JVM:

* a text is cut into single characters from U+00C0 on and the runs between them;
  a decomposable character becomes its first, second, ... decomposed character,
  each found by one ``translate`` table;
* a Hangul syllable is taken apart by arithmetic on its code point;
* runs of two or more combining marks are sorted by combining class, marks of
  one class in their order.

Texts without a character from U+00C0 on are returned after one regular expression
test.  Null stays null, the empty text stays empty.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hangul syllables: first code point, number of them; vowels and final
# consonants per leading consonant (fixed by the Unicode standard).
SYLLABLE, SYLLABLES, VOWELS, FINALS = 0xAC00, 11_172, 21, 28
LEADING = "".join(chr(0x1100 + i) for i in range(SYLLABLES // (VOWELS * FINALS)))
VOWEL = "".join(chr(0x1161 + i) for i in range(VOWELS))
FINAL = "".join(chr(0x11A8 + i) for i in range(FINALS - 1))


def char_class(code_points) -> str:
    """The inside of a regular expression's character class, as ranges."""
    runs: list[list[int]] = []
    for c in sorted(code_points):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in runs)


@cache
def tables() -> tuple[list[tuple[str, str]], str, str]:
    """(translate tables from the decomposable characters without Hangul to their
    k-th decomposed character, marks, their combining classes as characters)."""
    whole, marks = {}, {}
    for c in range(0x110000):
        if SYLLABLE <= c < SYLLABLE + SYLLABLES or 0xD800 <= c < 0xE000:
            continue
        parts = unicodedata.normalize("NFD", chr(c))
        if parts != chr(c):
            whole[chr(c)] = parts
        if unicodedata.combining(chr(c)):
            marks[chr(c)] = chr(0x100 + unicodedata.combining(chr(c)))
    # longest first: translate deletes the characters that have no k-th one
    source = sorted(whole, key=lambda c: (-len(whole[c]), c))
    steps = [("".join(source), "".join(whole[c][k] for c in source if len(whole[c]) > k))
             for k in range(max(map(len, whole.values())))]
    return steps, "".join(marks), "".join(marks.values())


def _syllable(c: Column) -> Column:
    at = F.ascii(c) - SYLLABLE
    final = at % FINALS
    return F.concat(F.substr(F.lit(LEADING), F.floor(at / (VOWELS * FINALS)).cast("int") + 1, F.lit(1)),
                    F.substr(F.lit(VOWEL), F.floor(at % (VOWELS * FINALS) / FINALS).cast("int") + 1, F.lit(1)),
                    F.when(final > 0, F.substr(F.lit(FINAL), final, F.lit(1))).otherwise(""))


def nfd(text) -> Column:
    """the canonical decomposition of a text."""
    t = F.col(text) if isinstance(text, str) else text
    steps, marks, classes = tables()
    mark = char_class(map(ord, marks))

    def apart(piece: Column) -> Column:
        first, *more = [F.translate(piece, a, b) for a, b in steps]
        return (F.when(first != piece, F.concat(first, *more))     # no character starts its own decomposition
                 .when(piece.between(chr(SYLLABLE), chr(SYLLABLE + SYLLABLES - 1)), _syllable(piece)).otherwise(piece))

    def in_order(piece: Column) -> Column:
        keyed = F.transform(F.regexp_extract_all(piece, F.lit("(?s)."), F.lit(0)),
                            lambda c, i: F.struct(F.translate(c, marks, classes).alias("k"), i.alias("i"), c.alias("c")))
        return F.when(piece.rlike(f"^[{mark}]{{2}}"), F.array_join(F.transform(F.array_sort(keyed), lambda s: s["c"]), "")) \
                .otherwise(piece)

    # nothing below U+00C0 is decomposable, no mark is below U+0300
    pieces = F.regexp_extract_all(t, F.lit(r"[^\x{0}-\x{bf}]|[\x{0}-\x{bf}]+"), F.lit(0))
    sorted_marks = F.transform(  # an array of one, so that the pieces are joined once
        F.array(F.array_join(F.transform(pieces, apart), "")),
        lambda x: F.when(x.rlike(r"[^\x{0}-\x{2ff}]{2}"), F.array_join(
            F.transform(F.regexp_extract_all(x, F.lit(f"[{mark}]+|[^{mark}]+"), F.lit(0)), in_order), "")).otherwise(x))
    return F.when(t.rlike(r"[^\x{0}-\x{bf}]"), sorted_marks[0]).otherwise(t)
