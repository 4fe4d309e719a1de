"""Text functions as JVM-side column expressions.

Everything here is built from ``pyspark.sql.functions``, so the rows stay in
the JVM; F2 (``nfd``) is in ``decompose.py``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexkit.functions.decompose import nfd

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference behaviour exactly).
# ---------------------------------------------------------------------------

# Tokenizer: a run of letters / digits / marks, or any single character that is
# neither a separator nor an "other" (control, format, private, unassigned).
TOKEN_PATTERN = r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"

# Text normalisation, single-character part.
# deleted: U+0001-0008, U+000E, U+000F, U+0011-001B (U+0000 and U+0010 kept), U+00AD
# to space: U+000B, U+000C, U+0085
# to '-': U+2010, U+2011, U+2012, U+2013, U+2014, U+2015, U+2043, U+2212, U+FF0D, U+207B
# to '"': U+201C, U+201D, U+201E, U+201F
# to "'": U+2018, U+2019, U+201A, U+201B, U+055A, U+A78B, U+A78C, U+FF07, U+0060, U+00B4,
#         U+2032, U+2035
# to '/': U+2044, U+2215
NORM_DELETE = [*range(0x01, 0x09), 0x0E, 0x0F, *range(0x11, 0x1C), 0xAD]
NORM_MAP = {
    " ": [0x0B, 0x0C, 0x85],
    "-": [0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2043, 0x2212, 0xFF0D, 0x207B],
    '"': [0x201C, 0x201D, 0x201E, 0x201F],
    "'": [0x2018, 0x2019, 0x201A, 0x201B, 0x055A, 0xA78B, 0xA78C, 0xFF07, 0x60, 0xB4,
          0x2032, 0x2035],
    "/": [0x2044, 0x2215],
}
# Text normalisation, multi-character part, applied in this order after the above.
NORM_MULTI = [
    ("″", "''"), ("‶", "''"),
    ("‴", "'''"), ("‷", "'''"),
    ("⁗", "''''"),
    ("…", "..."),
    (" . . . ", " ... "),
]

# Answer normalisation: ASCII punctuation removed, then these articles.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")

# Separator used to frame token runs for contiguous-sublist tests; it is a
# control character, so the tokenizer never emits it inside a token.
RUN_SEP = "\u0001"


def _translate_tables() -> tuple[str, str]:
    src, dst = [], []
    for out, cps in NORM_MAP.items():
        for cp in cps:
            src.append(chr(cp))
            dst.append(out)
    # characters of ``matching`` beyond the length of ``replace`` are deleted
    src.extend(chr(cp) for cp in NORM_DELETE)
    return "".join(src), "".join(dst)


_NORM_SRC, _NORM_DST = _translate_tables()


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_text(text) -> Column:
    """the ordered character rewrites (one translate + a few replaces)."""
    out = F.translate(_c(text), _NORM_SRC, _NORM_DST)
    for a, b in NORM_MULTI:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def simple_tokenize(text, uncased: bool = True) -> Column:
    """array of tokens (runs of letters/digits/marks, or one other visible char)."""
    t = _c(text)
    if uncased:
        t = F.lower(t)
    return F.regexp_extract_all(t, F.lit(TOKEN_PATTERN), F.lit(0))


def title_text(title, text) -> Column:
    """``title + ' ' + text`` when the title is non-empty, else the text."""
    ti, tx = _c(title), _c(text)
    return F.when(F.coalesce(F.length(ti), F.lit(0)) > 0, F.concat_ws(" ", ti, tx)).otherwise(tx)


def preprocess(text, normalize: bool = False, lower: bool = False) -> Column:
    """Optional normalisation, then optional lower-casing (same order everywhere)."""
    t = _c(text)
    if normalize:
        t = normalize_text(t)
    if lower:
        t = F.lower(t)
    return t


def truncate(tokens, max_len: int | None) -> Column:
    """Keep the first ``max_len`` tokens (None keeps all)."""
    t = _c(tokens)
    return t if not max_len else F.slice(t, 1, max_len)


def normalize_answer(s) -> Column:
    """lower -> drop ASCII punctuation -> articles to space -> collapse whitespace."""
    t = F.translate(F.lower(_c(s)), ASCII_PUNCTUATION, "")
    t = F.regexp_replace(t, r"(?U)\b(" + "|".join(ARTICLES) + r")\b", " ")
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    return F.trim(t)


def answer_tokens(s) -> Column:
    """Whitespace tokens of the normalised answer (empty array for an empty answer)."""
    n = normalize_answer(s)
    return F.when(F.length(n) == 0, F.array().cast("array<string>")).otherwise(F.split(n, " "))


def exact_match(pred, truth) -> Column:
    """equality after answer normalisation."""
    return normalize_answer(pred) == normalize_answer(truth)


def token_run(tokens) -> Column:
    """Join tokens into one framed string so that a contiguous sub-list test
    becomes a substring test: SEP t1 SEP t2 ... SEP."""
    return F.concat(F.lit(RUN_SEP), F.array_join(_c(tokens), RUN_SEP), F.lit(RUN_SEP))


def has_answer_tokens(text_tokens, answer_tokens_col) -> Column:
    """F7 core: does the answer token list occur contiguously in the text tokens?
    An empty answer occurs everywhere; a null text never matches."""
    tt, at = _c(text_tokens), _c(answer_tokens_col)
    return (F.when(tt.isNull(), F.lit(False))
            .when(F.size(at) == 0, F.lit(True))
            .otherwise(F.instr(token_run(tt), token_run(at)) > 0))


def qa_tokens(text, decompose: bool = True) -> Column:
    """Tokens used by the answer check: NFD (optional), tokenise, lower-case."""
    t = _c(text)
    if decompose:
        t = nfd(t)
    return simple_tokenize(t, uncased=True)
