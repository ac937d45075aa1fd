"""Column functions on sequences: alphabets, k-mers, hashes, set and edit similarity, physico-chemical features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Residues, reduced alphabets (one symbol for each residue, in the order that translate takes), masses, hydropathy, groups and pKa.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
ALPHABETS = {"groups5": "HS--HS+H+HHPSP+PPHHH", "groups7": "AC--RG+A+AAPGP+PPARR"}
MASS = dict(zip(RESIDUES, (89.1, 121.2, 133.1, 147.1, 165.2, 75.1, 155.2, 131.2, 146.2, 131.2, 149.2, 132.1, 115.1, 146.2, 174.2, 105.1, 119.1, 117.1, 204.2, 181.2), strict=True))
UNKNOWN_MASS, WATER = 110.0, 18.01528
HYDROPATHY = dict(zip(RESIDUES, (1.8, 2.5, -3.5, -3.5, 2.8, -0.4, -3.2, 4.5, -3.9, 3.8, 1.9, -3.5, -1.6, -3.5, -4.5, -0.8, -0.7, 4.2, -0.9, -1.3), strict=True))
GROUPS = {"aromatic": "FWY", "aliphatic": "AVILM", "polar": "STNQ", "positive": "KRH", "negative": "DE", "special": "GPC"}
ACIDS, BASES, N_TERM, C_TERM = {"D": 3.9, "E": 4.1, "C": 8.3, "Y": 10.1}, {"H": 6.0, "K": 10.5, "R": 12.5}, 8.0, 3.1
PRIME = 2_147_483_647


def _whole(name: str, value: int, least: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be an integer of {least} or more")
    return value


def alphabet_mapping(name: str) -> dict[str, str] | None:
    if name == "none":
        return None
    if name not in ALPHABETS:
        raise ValueError(f"unknown reduced alphabet: {name}")
    return dict(zip(RESIDUES, ALPHABETS[name], strict=True))


def is_reduced(name: str) -> bool:
    return alphabet_mapping(name) is not None


def reduce_alphabet(seq: Column, name: str) -> Column:
    """Group symbols for residues, X for anything else."""
    if not is_reduced(name):
        return seq
    return F.translate(F.regexp_replace(seq, f"[^{RESIDUES}]", "X"), RESIDUES, ALPHABETS[name])


def kmers(seq: Column, k: int) -> Column:
    """Distinct substrings of length k; none for shorter sequences."""
    _whole("k", k, 1)
    at = F.sequence(F.lit(1), F.length(seq) - k + 1)
    return F.when(F.length(seq) >= k, F.array_distinct(F.transform(at, lambda i: F.substring(seq, i, k)))).otherwise(F.array().cast("array<string>"))


def kmer_hash(kmer: Column) -> Column:
    return F.crc32(F.encode(kmer, "UTF-8"))


def coefficients(hashes: int, seed: int) -> tuple[list[int], list[int]]:
    """Multipliers and offsets of the hash family, from NumPy's legacy generator."""
    _whole("hashes", hashes, 1)
    r = np.random.RandomState(seed)
    return [list(map(int, r.randint(low, PRIME, hashes))) for low in (1, 0)]


def minhash(kmer_set: Column, hashes: int, seed: int) -> Column:
    """Minima of (a * crc32 + b) mod 2**31 - 1 over the set, one for each hash; the prime for empty sets."""
    a, b = coefficients(hashes, seed)
    values = F.transform(kmer_set, lambda x: kmer_hash(x) % PRIME)

    def least(m: int, o: int) -> Column:
        return F.coalesce(F.array_min(F.transform(values, lambda h: (h * m + o) % PRIME)), F.lit(PRIME)).cast("long")

    return F.array(*(least(m, o) for m, o in zip(a, b, strict=True)))


def estimated_jaccard(a: Column, b: Column, hashes: int) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.lit(float(hashes))


def jaccard(common: Column, na: Column, nb: Column) -> Column:
    """From sizes; no evidence (an empty set) is 0."""
    return F.when((na > 0) & (nb > 0), common / (na + nb - common)).otherwise(F.lit(0.0))


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are the same, 1."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.when(both > 0, both))


def containment(common: Column, na: Column, nb: Column) -> Column:
    return F.when((na > 0) & (nb > 0), common / F.least(na, nb)).otherwise(F.lit(0.0))


def cosine(common: Column, na: Column, nb: Column) -> Column:
    return F.when((na > 0) & (nb > 0), common / F.sqrt(na.cast("double") * nb)).otherwise(F.lit(0.0))


def edit_bound(a: Column, b: Column, threshold: float) -> Column:
    """Largest distance that a threshold allows, in binary floating point as the threshold is."""
    return ((F.lit(1.0) - F.lit(float(threshold))) * F.greatest(F.length(a), F.length(b))).cast("int")


def edit_identity(a: Column, b: Column, bound: Column | None = None) -> Column:
    """1 - distance / longer length; both empty 1; over the bound 0."""
    d = F.levenshtein(a, b) if bound is None else F.call_function("levenshtein", a, b, bound)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).when(d < 0, F.lit(0.0)).otherwise(F.lit(1.0) - d / longest)


def residue_count(seq: Column, residue: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(residue), F.lit("")))


def features(seq: Column, ph: float = 7.0) -> dict[str, Column]:
    """The 32 features by name, in order; null for empty sequences."""
    if isinstance(ph, bool) or not 0 <= ph <= 14:
        raise ValueError("pH must be from 0 to 14")
    n = F.when(F.length(seq) > 0, F.length(seq).cast("double"))
    count = {r: residue_count(seq, r) for r in RESIDUES}
    total = lambda rs: sum((count[r] for r in rs), F.lit(0))
    known = total(RESIDUES)
    charge = F.lit(1 / (1 + 10 ** (ph - N_TERM)) + 1 / (1 + 10 ** (ph - C_TERM)) - 1)
    for r, pka in ACIDS.items():
        charge = charge + count[r] * F.lit(1 / (1 + 10 ** (ph - pka)) - 1)
    for r, pka in BASES.items():
        charge = charge + count[r] * F.lit(1 / (1 + 10 ** (ph - pka)))
    mass = sum((count[r] * F.lit(m) for r, m in MASS.items()), F.lit(0.0)) + (n - known) * UNKNOWN_MASS - (n - 1) * WATER
    water = sum((count[r] * F.lit(h) for r, h in HYDROPATHY.items()), F.lit(0.0))
    out = {f"freq_{r}": count[r] / n for r in RESIDUES} | {f"grp_{g}": total(rs) / n for g, rs in GROUPS.items()}
    out |= {"aromaticity": total("FWY") / n, "charge": F.when(n > 0, charge), "hydrophobicity": F.when(n.isNull(), F.lit(None)).when(known > 0, water / F.when(known > 0, known)).otherwise(F.lit(0.0)), "length": n, "mw": mass, "unknown_fraction": (n - known) / n}
    return dict(sorted(out.items()))


FEATURE_NAMES = sorted([f"freq_{r}" for r in RESIDUES] + [f"grp_{g}" for g in GROUPS] + ["aromaticity", "charge", "hydrophobicity", "length", "mw", "unknown_fraction"])
