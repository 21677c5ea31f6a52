"""Text column functions.

Six normal forms exist and none may stand in for another: association text,
fragment text, evaluation text, two compact forms and the region variation key.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@cache
def foldings() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Full case folding by the interpreter's tables: letters with one-letter foldings, those, and the longer foldings."""
    changed = [(ch, ch.casefold()) for ch in map(chr, range(0x110000)) if ch.casefold() != ch]
    one = [(a, b) for a, b in changed if len(b) == 1]
    return "".join(a for a, _ in one), "".join(b for _, b in one), tuple((a, b) for a, b in changed if len(b) > 1)


def fold(c: Column) -> Column:
    """Full case folding, as the Python kernels have it.

    In the Latin blocks lower case is the folding but for a few letters; only texts with one of those, or with letters
    of other blocks, go through the whole table.
    """
    letters, folded, long = foldings()
    sharp = F.replace(c, F.lit("ß"), F.lit("ss"))
    odd = "".join(ch for ch in map(chr, range(0x250)) if ch.casefold() != ch.lower() and ch != "ß")
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in long])
    spelled = F.aggregate(pairs, sharp, lambda t, x: F.replace(t, x["a"], x["b"]))
    usual = F.octet_length(sharp) == F.char_length(sharp)
    usual = usual | sharp.rlike(rf"\A[\x00-\x{{24F}}&&[^{odd}]]*+\z")
    return F.when(usual, F.lower(sharp)).otherwise(F.translate(spelled, letters, folded))


# Forms of a folded text; a query that needs several folds once.


def caption_of(folded: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(folded, F.lit("_"), F.lit(" ")), r"[^\p{L}\p{N}']+", " "))


def fragment_of(folded: Column) -> Column:
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}_']+", " "))


def compact_of(folded: Column) -> Column:
    return F.regexp_replace(folded, r"[^\p{L}\p{N}_]+", "")


def norm_caption(c: Column) -> Column:
    return caption_of(fold(c))


def norm_fragment(c: Column) -> Column:
    return fragment_of(fold(c))


def compact_caption(c: Column) -> Column:
    return compact_of(fold(c))


@F.pandas_udf(StringType())
def _norm_eval_unicode(values: pd.Series) -> pd.Series:
    def one(value):
        if value is None:
            return None
        folded = unicodedata.normalize("NFKC", value).casefold()
        for ch in set(folded):
            if not ch.isalnum():
                folded = folded.replace(ch, " ")
        return " ".join(folded.split())

    return values.map(one, na_action="ignore")


def norm_eval(c: Column) -> Column:
    """Evaluation text. Only rows with non-ASCII text reach Python."""
    plain = F.octet_length(c) == F.char_length(c)
    ascii_form = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    return F.when(plain, ascii_form).otherwise(_norm_eval_unicode(F.when(~plain, c)))


def without_spaces(norm: Column) -> Column:
    return F.replace(norm, F.lit(" "), F.lit(""))


def compact_eval(c: Column) -> Column:
    return without_spaces(norm_eval(c))


def clean_ocr(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit("|"), F.lit("I")), r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    """Editor text: no NULs, LF line ends, trimmed."""
    no_nul = F.replace(c, F.lit("\x00"), F.lit(""))
    lf = F.replace(F.replace(no_nul, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(lf, r"(?U)\A\s+|\s+\z", "")


def variation_key(c: Column) -> Column:
    return compact_of(fold(c))


def tokens(norm: Column) -> Column:
    """Token list of an already normalised text."""
    return F.filter(F.split(norm, " "), lambda t: t != "")


def token_count(norm: Column) -> Column:
    return F.when(norm == "", F.lit(0)).otherwise(
        F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1
    )


def token_run_contained(a: Column, b: Column, strict: bool = True) -> Column:
    """The shorter token list is a contiguous run of the longer one.

    ``a`` and ``b`` are normalised texts; ``strict`` asks for unequal lengths.
    """
    na, nb = token_count(a), token_count(b)
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    inside = F.when(na <= nb, F.contains(pad(b), pad(a))).otherwise(F.contains(pad(a), pad(b)))
    sizes = (na != nb) if strict else F.lit(True)
    return (na > 0) & (nb > 0) & sizes & inside


def token_subset(inner: Column, outer: Column) -> Column:
    """Both token sets are non-empty and inner is a subset of outer."""
    ti, to = tokens(inner), tokens(outer)
    return (F.size(ti) > 0) & (F.size(to) > 0) & (F.size(F.array_except(ti, to)) == 0)


def line_breaks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def ends_sentence(word: Column) -> Column:
    return F.trim(word).rlike("[.!?][\"']?$")


def ends_clause(word: Column) -> Column:
    return F.trim(word).rlike("[,;:][\"']?$")


def containment_score(a: Column, b: Column) -> Column:
    """Caption similarity where one normal form contains the other, else null."""
    la, lb = F.length(a), F.length(b)
    ratio = F.least(la, lb) / F.greatest(la, lb)
    shorter = F.when(la <= lb, a).otherwise(b)
    strong = F.lit(0.72) + ratio * F.lit(0.28)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(
        F.contains(a, b) | F.contains(b, a),
        F.when(token_count(shorter) >= 2, strong).otherwise(ratio),
    )


def matcher_bound(a: Column, b: Column) -> Column:
    """Upper bound of the matcher ratio from the two lengths."""
    la, lb = F.length(a), F.length(b)
    return F.least(la, lb) * 2.0 / (la + lb)
