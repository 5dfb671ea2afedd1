"""Text functions of labels and codes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column) -> Column:
    """A short id of the parts' content, whatever their row's place."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12))


def shape(text: Column) -> Column:
    """Digits as 9, letters as A."""
    return F.regexp_replace(F.regexp_replace(text, r"\p{N}", "9"), r"\p{L}", "A")


def compressed_pattern(text: Column) -> Column:
    """The shape with runs written once."""
    return F.regexp_replace(F.regexp_replace(text, r"\p{N}+", "9"), r"\p{L}+", "A")


def digits_from_glyphs(text: Column) -> Column:
    """Letters that look like digits, as those digits. The look-alikes."""
    return F.translate(text, "OoIlSBZGq", "001158269")


def count_prefix(text: Column) -> Column:
    """(n, rest) of '2xKV1': one and the whole text without a count."""
    n = F.regexp_extract(text, r"^([0-9]{1,2})x(?=\p{L})", 1)
    return F.struct(F.when(n == "", 1).otherwise(F.expr("1") * F.when(n == "", "1").otherwise(n).cast("int")).alias("n"), F.regexp_replace(F.regexp_replace(text, r"^[0-9]{1,2}x(?=\p{L})", ""), r",+$", "").alias("rest"))


def split_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[-_/#. ]+"), lambda t: t != "")


def identity(text: Column, dn: Column) -> Column:
    """(base, qualifier, key): the first token, the others, and base with its dimension or a question mark."""
    t = split_tokens(text)
    base = F.coalesce(F.try_element_at(t, F.lit(1)), F.lit(""))
    return F.struct(base.alias("base"), F.array_join(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), "-").alias("qualifier"), F.concat(base, F.lit("|DN"), F.coalesce(dn.cast("string"), F.lit("?"))).alias("key"))


def number(text: Column) -> Column:
    """A number with decimal comma and spaces between thousands; null if it is none."""
    return F.regexp_replace(F.regexp_replace(text, r"[\s\x{A0}]", ""), ",", ".").try_cast("double")


def elevation(text: Column) -> Column:
    """(tag, value in millimetres) of 'VG+12,30': metres where decimals are given, else millimetres; null if none is there."""
    tag, sign, digits = (F.regexp_extract(text, r"([A-Z]{2})([+-])([0-9]+(?:,[0-9]+)?)", k) for k in (1, 2, 3))
    value = F.when(digits.contains(","), F.round(number(digits) * 1000)).otherwise(number(digits)).cast("bigint")
    return F.when(tag != "", F.struct(tag.alias("tag"), (value * F.when(sign == "-", -1).otherwise(1)).alias("mm")))


def variant(key: str, session: Column, share_b: float) -> Column:
    """A or B by the first four bytes of a hash of key and session."""
    part = F.conv(F.substring(F.sha2(F.concat(F.lit(key + ":"), session), 256), 1, 8), 16, 10).cast("double") / 4294967295
    return F.when(part < share_b, "B").otherwise("A")


#: Words of a description and the role they give a code; a thing says more than a medium.
ROLE_WORDS = {"bolt": "component", "ring": "component", "gear": "component", "widget": "system", "gizmo": "system", "red": "material", "blue": "material"}


def role_from_words(text: Column) -> Column:
    """The role of the last word that has one."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    roles = F.create_map(*[F.lit(x) for pair in ROLE_WORDS.items() for x in pair])
    known = F.filter(F.transform(words, lambda w: F.try_element_at(roles, w)), lambda r: r.isNotNull())
    return F.try_element_at(known, F.lit(-1))
