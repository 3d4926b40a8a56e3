"""Alphabets: validation, normalisation, complement and collapse, as column expressions (FN1-FN11, FN17, FN18, FN21).

Decisions where the semantics are not given: case is folded and U is read as T in every alphabet; unknown symbols are all
replaced, not only the first of a sequence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters in rank order after the delimiter, complements, and the collapsed alphabets.
LETTERS = {"dna4": "ACGT", "dna5": "ACGTN", "dr_dna4": "WS", "dr_dna5": "WSN"}
COMPLEMENT = ("ACGTN", "TGCAN")
COLLAPSE = {"dr_dna4": ("WAaTtUuSCcGg", "WWWWWWWSSSSS"), "dr_dna5": ("WAaTtUuSCcGgNn", "WWWWWWWSSSSSNN")}


def letters(alphabet: str) -> str:
    if alphabet not in LETTERS:
        raise ValueError(f"unknown alphabet {alphabet!r}; known are {', '.join(LETTERS)}")
    return LETTERS[alphabet]


def sigma(alphabet: str) -> int:
    """Symbols, the delimiter included."""
    return len(letters(alphabet)) + 1


def normalise(seq: Column, alphabet: str = "dna5") -> Column:
    """Upper case, U as T; collapsed alphabets map to their classes."""
    if alphabet in COLLAPSE:
        return collapse(seq, alphabet)
    return F.replace(F.upper(seq), F.lit("U"), F.lit("T"))


def ranks(seq: Column, alphabet: str = "dna5") -> Column:
    """Ranks from 1 on (0 is the delimiter); symbols outside the alphabet have rank 255."""
    known = letters(alphabet)
    at = lambda c: F.position(c, F.lit(known))
    return F.transform(F.split(normalise(seq, alphabet), ""), lambda c: F.when(at(c) > 0, at(c)).otherwise(255))


def first_invalid(seq: Column, alphabet: str = "dna5") -> Column:
    """0-based place of the first symbol outside the alphabet, -1 if all are inside (FN2)."""
    return F.regexp_instr(normalise(seq, alphabet), F.lit(f"[^{letters(alphabet)}]")) - 1


def is_valid(seq: Column, alphabet: str = "dna5") -> Column:
    return normalise(seq, alphabet).rlike(f"^[{letters(alphabet)}]*$")


def require_valid(seq: Column, name: Column, ordinal: Column, alphabet: str = "dna5") -> Column:
    """The normalised sequence, or an error with record, symbol and place (FN4)."""
    s, at = normalise(seq, alphabet), first_invalid(seq, alphabet)
    bad = F.substring(F.upper(seq), at + 1, F.lit(1))
    message = F.format_string("record %s (number %s) has symbol '%s' (0x%s) at place %s, which the alphabet " + alphabet + " lacks", name, ordinal.cast("string"), bad, F.hex(bad), at.cast("string"))
    return F.when(at < 0, s).otherwise(F.raise_error(message))


def pick(seed: int, *parts: Column, of: str = "ACGT") -> Column:
    """A letter of `of` drawn from a hash of the parts: equal on every run and partitioning (FN21)."""
    return F.substring(F.lit(of), (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(len(of))) + 1).cast("int"), F.lit(1))


def replace_unknown(seq: Column, alphabet: str = "dna5", key: Column | None = None, seed: int = 0) -> Column:
    """Unknown symbols become N where the alphabet has it (FN5), else letters drawn by (seed, key, place) (FN6, FN7)."""
    s, known = normalise(seq, alphabet), letters(alphabet)
    if "N" in known:
        return F.regexp_replace(s, f"[^{known}]", "N")
    row = key if key is not None else F.xxhash64(seq)
    drawn = F.array_join(F.transform(F.split(s, ""), lambda c, i: F.when(c.rlike(f"[{known}]"), c).when(c == "", c).otherwise(pick(seed, row, i, of=known))), "")
    return F.when(s.rlike(f"[^{known}]"), drawn).otherwise(s)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, *COMPLEMENT))


def collapse(seq: Column, alphabet: str = "dr_dna5") -> Column:
    """Complement pairs become one symbol, so that the reverse complement is the reverse (FN11)."""
    return F.translate(seq, *COLLAPSE[alphabet])


def window(seq: Column, pos: Column, n: Column) -> Column:
    """n symbols from the 0-based place on; on bytes, as slices of strings walk from their start."""
    return F.substring(seq.cast("binary"), (pos + 1).cast("int"), n.cast("int")).cast("string")
