"""Functions of DNA strings as columns: all visible to Catalyst, none in Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def clean(text: Column) -> Column:
    """Upper-cased text without anything but A, C, G and T: turns any string into a sequence."""
    return F.regexp_replace(F.upper(text), "[^ACGT]", "")


def complement(s: Column) -> Column:
    """Complement with case kept; ambiguity codes become N."""
    return F.translate(s, "ACGTRYSWKMBDHVacgtryswkmbdhv", "TGCANNNNNNNNNNtgcannnnnnnnnn")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(F.upper(s)))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def is_palindrome(s: Column) -> Column:
    return s == reverse_complement(s)


def count_base(s: Column, base: str) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(base), F.lit("")))) / len(base)


def gc_count(s: Column) -> Column:
    return F.length(F.translate(s, "ATN", ""))


def gc_content(s: Column) -> Column:
    """Share of G and C; 0 for the empty string."""
    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(gc_count(s) / F.length(s))


def gc_last(s: Column, n: int) -> Column:
    return gc_count(F.right(s, F.lit(n)))


def longest_run(s: Column, base: str) -> Column:
    """Length of the longest run of one base."""
    runs = F.transform(F.regexp_extract_all(s, F.lit(f"{base}+"), F.lit(0)), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def kmers(s: Column, k: int | Column) -> Column:
    """All k-mers of a string in order; an empty array if it is shorter."""
    k = F.lit(k) if isinstance(k, int) else k
    n = F.length(s) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(s, i, k))).otherwise(F.array().cast("array<string>"))


def hamming(a: Column, b: Column) -> Column:
    """Mismatches of two strings over the shorter length, plus the difference of lengths."""
    n = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + F.when((i <= n) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), 1).otherwise(0))
    return F.greatest(F.length(a), F.length(b)) - same


def shares_substring(a: Column, b: Column, length: int) -> Column:
    """Whether two strings have a common substring of ``length``."""
    return F.coalesce(F.arrays_overlap(kmers(a, length), kmers(b, length)), F.lit(False))


def longest_common_substring(a: Column, b: Column, most: int = 18) -> Column:
    """Length of the longest common substring, up to ``most``."""
    # a common substring holds shorter ones, so lengths are tried upwards and the first that fails ends it
    out = F.when(~shares_substring(a, b, 1), 0)
    for t in range(2, most + 1):
        out = out.when(~shares_substring(a, b, t), t - 1)
    return out.otherwise(most)


def is_dimer(a: Column, b: Column, most: int) -> Column:
    """Whether ``a`` and the reverse complement of ``b`` share more than ``most`` bases in a row."""
    return shares_substring(a, reverse_complement(b), most + 1)


def mismatch_variants(s: Column) -> Column:
    """All strings that differ in exactly one base, in order of place and base."""
    at = F.transform(
        F.sequence(F.lit(1), F.length(s)),
        lambda i: F.transform(
            F.filter(F.array(*[F.lit(b) for b in BASES]), lambda b: b != F.substring(s, i, F.lit(1))),
            lambda b: F.concat(F.substring(s, F.lit(1), i - 1), b, F.substring(s, i + 1, F.length(s))),
        ),
    )
    return F.flatten(at)


def base_entropy(s: Column) -> Column:
    """Shannon entropy of the base composition in bits."""
    n = F.length(s)
    terms = [F.when(count_base(s, b) > 0, -(count_base(s, b) / n) * F.log2(count_base(s, b) / n)).otherwise(0.0) for b in BASES]
    return F.when(n == 0, 0.0).otherwise(terms[0] + terms[1] + terms[2] + terms[3])


def linguistic_complexity(s: Column) -> Column:
    """Distinct substrings over n(n+1)/2."""
    n = F.length(s)
    subs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(s, i, k))))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_distinct(subs)) / (n * (n + 1) / 2))


def kmer_diversity(s: Column, k: int = 4) -> Column:
    """Distinct k-mers over all k-mers; 0 if there is none."""
    return F.when(F.length(s) < k, 0.0).otherwise(F.size(F.array_distinct(kmers(s, k))) / F.size(kmers(s, k)))


def end_code(base: Column) -> Column:
    """A 0, G 1, T 2, C 3."""
    return F.instr(F.lit("AGTC"), base) - 1


def has_homopolymer(s: Column, n: int) -> Column:
    return F.rlike(s, F.lit("|".join(f"{b}{{{n}}}" for b in BASES)))


def dinucleotide_pattern(times: int = 5, with_runs: bool = False) -> str:
    """A pair of bases ``times`` in a row; written out, as linear-time engines have no back-references."""
    return "|".join(f"({a}{b}){{{times}}}" for a in BASES for b in BASES if with_runs or a != b)


def has_dinucleotide_repeat(s: Column, times: int = 5, with_runs: bool = False) -> Column:
    return F.rlike(s, F.lit(dinucleotide_pattern(times, with_runs)))


def tokens(s: Column) -> Column:
    """Bases as numbers: A 1, C 2, G 3, T 4, other 5."""
    return F.transform(F.split(s, ""), lambda c: F.when(F.instr(F.lit(BASES), c) > 0, F.instr(F.lit(BASES), c)).otherwise(5))
