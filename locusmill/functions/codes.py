"""Column expressions for marker keys, genotype codes and channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channel order of the ten unordered allele pairs.
CHANNELS = ["AA", "AT", "AC", "AG", "TT", "TC", "TG", "CC", "CG", "GG"]
ALLELES = ["A", "C", "G", "T"]
# Packed two-bit call -> copies of the counted allele (1 = missing).
PACKED_ALLELE_2 = [0, None, 1, 2]
PACKED_ALLELE_1 = [2, None, 1, 0]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_chrom(chrom: str | Column) -> Column:
    """``1.0`` -> ``1``; text that is no number is only trimmed."""
    text = F.trim(_col(chrom).cast("string"))
    number = text.try_cast("double")
    whole = number.isNotNull() & ~F.isnan(number) & (F.floor(number) == number)
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(text)


def normalize_pos(pos: str | Column) -> Column:
    """Truncate a numeric string to a whole position; anything else is an error."""
    text = F.trim(_col(pos).cast("string"))
    number = text.try_cast("double")
    bad = number.isNull() | F.isnan(number)
    return F.when(
        bad, F.raise_error(F.concat(F.lit("unreadable marker position: "), F.coalesce(text, F.lit("NULL"))))
    ).otherwise(number).cast("bigint")


def chr_pos_id(chrom: str | Column, pos: str | Column) -> Column:
    return F.concat_ws(":", normalize_chrom(chrom), normalize_pos(pos).cast("string"))


def plain_chrom(chrom: str | Column) -> Column:
    """Chromosome without a ``chr`` prefix, so all spellings meet in one key."""
    return F.regexp_replace(normalize_chrom(chrom), "^chr", "")


def decode_call_code(code: str | Column, count_allele: int) -> Column:
    """Two-bit packed code -> dosage; the counted allele must be named."""
    if count_allele not in (1, 2):
        raise ValueError("count_allele must be 1 or 2")
    table = PACKED_ALLELE_2 if count_allele == 2 else PACKED_ALLELE_1
    return F.element_at(
        F.array(*[F.lit(v).cast("int") for v in table]), _col(code).cast("int") + 1
    )


def missing_to_null(code: str | Column, missing_code: int) -> Column:
    return F.nullif(_col(code), F.lit(missing_code))


def _channel_map() -> Column:
    pairs = []
    for index, pair in enumerate(CHANNELS):
        pairs += [F.lit(pair), F.lit(index)]
        if pair[0] != pair[1]:
            pairs += [F.lit(pair[::-1]), F.lit(index)]
    return F.create_map(*pairs)


def encode_channel(a1: str | Column, a2: str | Column, dosage: str | Column) -> Column:
    """Channel 0..9 of a call; NULL for a missing call or an allele outside ACGT."""
    left, right, d = F.upper(_col(a1)), F.upper(_col(a2)), _col(dosage)
    pair = (
        F.when(d == 0, F.concat(left, left))
        .when(d == 1, F.concat(left, right))
        .when(d == 2, F.concat(right, right))
    )
    return F.try_element_at(_channel_map(), pair)


def decode_channel(a1: str | Column, a2: str | Column, channel: str | Column) -> Column:
    """Copies of ``a2`` behind a channel; NULL where the pair does not fit the marker."""
    c = _col(channel)
    return F.coalesce(
        *[F.when(encode_channel(a1, a2, F.lit(d)) == c, F.lit(d)) for d in (0, 1, 2)]
    )


def onehot(channel: str | Column) -> Column:
    """Ten-element vector; all zero where the call is missing."""
    c = _col(channel)
    return F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda i: F.when(i == c, F.lit(1.0)).otherwise(F.lit(0.0)),
    )


def is_one_hot(vector: str | Column) -> Column:
    v = _col(vector)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return F.forall(v, lambda x: x.isin(0.0, 1.0)) & total.isin(0.0, 1.0) & (F.size(v) == 10)


def sigmoid(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))


def iid_sample_id(fid: str | Column, iid: str | Column, rule: str) -> Column:
    """Sample ID from family and individual ID.

    ``joined``: FID_IID.  ``individual``: IID, doubled as IID_IID where FID = IID.
    """
    f, i = _col(fid), _col(iid)
    if rule == "joined":
        return F.concat_ws("_", f, i)
    if rule == "individual":
        return F.when(f == i, F.concat_ws("_", i, i)).otherwise(i)
    raise ValueError(f"unknown sample ID rule {rule!r}")


def id_aliases(fid: str | Column, iid: str | Column) -> Column:
    """The four spellings under which a sample may be listed."""
    f, i = _col(fid), _col(iid)
    return F.array_distinct(
        F.array(i, F.concat(f, F.lit("_"), i), F.concat(f, F.lit(":"), i), F.concat(f, F.lit("-"), i))
    )
