"""Token-array edits (P4, F12-F16, F18, F19, F21) as column expressions.

Random choices are hash uniforms (``lexkit.functions.hashing``) keyed by the
row key and the element position, so each row is edited independently and
repeatably, inside the JVM, with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexkit.functions.hashing import uniform


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def chunk(tokens, offset, length: int) -> Column:
    """tokens[offset : offset + length] (shorter or empty past the end)."""
    # slice returns an empty array when the start lies past the end
    return F.slice(_c(tokens), _c(offset) + 1, length)


def crop_length(n, ratio) -> Column:
    return F.floor(_c(n).cast("double") * _c(ratio)).cast("int")


def random_crop(tokens, ratio_min: float, ratio_max: float, seed: int, tag: str, *keys) -> Column:
    """ratio ~ U[rmin, rmax]; len = floor(n ratio); start ~ U{0..n-len}."""
    t = _c(tokens)
    n = F.size(t)
    ratio = F.lit(ratio_min) + F.lit(ratio_max - ratio_min) * uniform(seed, tag + ":ratio", *keys)
    ln = crop_length(n, ratio)
    start = F.floor(uniform(seed, tag + ":start", *keys) * (n - ln + 1)).cast("int")
    return F.slice(t, start + 1, ln)


def _pos_uniform(seed, tag, keys, i):
    return uniform(seed, tag, *keys, i)


def delete_tokens(tokens, p: float, seed: int, tag: str, *keys) -> Column:
    """keep an element when its uniform u > p."""
    return F.filter(_c(tokens), lambda x, i: _pos_uniform(seed, tag, keys, i) > F.lit(p))


def replace_tokens(tokens, lo: int, hi: int, p: float, seed: int, tag: str, *keys) -> Column:
    """with probability p an element becomes a random id in [lo, hi]."""
    def f(x, i):
        u = _pos_uniform(seed, tag, keys, i)
        r = (F.lit(lo) + F.floor(_pos_uniform(seed, tag + ":id", keys, i) * F.lit(hi - lo + 1))).cast("int")
        return F.when(u > F.lit(p), x).otherwise(r)
    return F.transform(_c(tokens), f)


def mask_tokens(tokens, mask_id: int, p: float, seed: int, tag: str, *keys) -> Column:
    """with probability p an element becomes ``mask_id``."""
    return F.transform(_c(tokens), lambda x, i: F.when(_pos_uniform(seed, tag, keys, i) > F.lit(p), x)
                       .otherwise(F.lit(mask_id)))


def shuffle_tokens(tokens, p: float, seed: int, tag: str, *keys) -> Column:
    """F16: positions with u < p are chosen; their values are permuted among them
    (the k-th chosen position, in position order, receives the value of the k-th
    chosen position in hash order)."""
    t = _c(tokens)
    idx = F.sequence(F.lit(0), F.size(t) - 1)
    chosen = F.filter(F.when(F.size(t) > 0, idx).otherwise(F.array().cast("array<int>")),
                      lambda i: _pos_uniform(seed, tag, keys, i) < F.lit(p))
    # chosen positions ordered by a second uniform = the permutation source
    by_hash = F.transform(
        F.array_sort(F.transform(chosen, lambda i: F.struct(
            _pos_uniform(seed, tag + ":perm", keys, i).alias("u"), i.alias("i")))),
        lambda s: s["i"])
    def f(x, i):
        k = F.array_position(chosen, i)
        return F.when(k > 0, F.element_at(t, F.element_at(by_hash, k.cast("int")) + 1)).otherwise(x)
    return F.transform(t, f)


def augment(tokens, kind: str | None, p: float, seed: int, tag: str, *keys,
            mask_id: int | None = None, lo: int | None = None, hi: int | None = None) -> Column:
    """dispatch to one of the edits; anything else is the identity."""
    if kind == "mask":
        return mask_tokens(tokens, mask_id, p, seed, tag, *keys)
    if kind == "replace":
        return replace_tokens(tokens, lo, hi, p, seed, tag, *keys)
    if kind == "delete":
        return delete_tokens(tokens, p, seed, tag, *keys)
    if kind == "shuffle":
        return shuffle_tokens(tokens, p, seed, tag, *keys)
    return _c(tokens)


def add_bos_eos(tokens, bos: int | None, eos: int | None) -> Column:
    """prepend / append whichever id is given."""
    parts = []
    if bos is not None:
        parts.append(F.array(F.lit(bos)))
    parts.append(_c(tokens))
    if eos is not None:
        parts.append(F.array(F.lit(eos)))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def add_token(tokens, token: int) -> Column:
    """prepend one id."""
    return F.concat(F.array(F.lit(token)), _c(tokens))


def pad(tokens, width, pad_id: int = 0) -> Column:
    """F21 ids: right-pad with ``pad_id`` up to ``width``."""
    t = _c(tokens)
    return F.concat(t, F.array_repeat(F.lit(pad_id), F.greatest(_c(width) - F.size(t), F.lit(0))))


def pad_mask(tokens, width) -> Column:
    """F21 mask: 1 for real positions, 0 for padding."""
    t = _c(tokens)
    return F.concat(F.array_repeat(F.lit(1), F.size(t)),
                    F.array_repeat(F.lit(0), F.greatest(_c(width) - F.size(t), F.lit(0))))
