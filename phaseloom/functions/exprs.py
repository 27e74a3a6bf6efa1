"""Column expressions: phases, ids, text normalisation and tolerant casts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def wrap_phase(x: Column) -> Column:
    """x modulo a full turn, in [-pi, pi)."""
    return F.pmod(x + math.pi, F.lit(TAU)) - math.pi


def excess_winding(q_abs: Column, q_net: Column, eps: float = 1e-12) -> Column:
    """(q_abs - |q_net|) / (|q_net| + eps)."""
    return (q_abs - F.abs(q_net)) / (F.abs(q_net) + eps)


def excess_share(q_abs: Column, q_net: Column) -> Column:
    """(q_abs - |q_net|) / q_abs, 0 where nothing winds."""
    return F.when(q_abs == 0, F.lit(0.0)).otherwise((q_abs - F.abs(q_net)) / q_abs)


def stable_id(*parts: Column, prefix: str = "", size: int = 16) -> Column:
    """First hex digits of the SHA-256 of the parts, joined by '|'."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, size))


def hash_seed(*parts: Column) -> Column:
    """An integer below 2**32 from the first eight hex digits of the SHA-256 of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


def hash_unit(*parts: Column) -> Column:
    """hash_seed() scaled to [0, 1)."""
    return hash_seed(*parts) / F.lit(float(1 << 32))


def collapse(text: Column) -> Column:
    """Lower-case, white space runs as one space, trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def tokens(text: Column) -> Column:
    """Lower-case words of two characters or more; letters up to Latin Extended-B count as word characters."""
    return F.filter(F.split(F.lower(text), "[^\\wÀ-ɏ]+"), lambda t: F.char_length(t) > 1)


def number(cell: Column) -> Column:
    """A double, or null where the trimmed cell is empty or no number."""
    return F.nullif(F.trim(cell), F.lit("")).try_cast("double")


def phrase_hits(text: Column, phrases: list[str]) -> Column:
    """The phrases, in the given order, that the collapsed text contains."""
    flat = collapse(text)
    return F.array_compact(F.array(*[F.when(F.contains(flat, F.lit(p)), F.lit(p)) for p in phrases]))


def first_blocker(*rules: tuple[Column, str], otherwise: str) -> Column:
    """The message of the first rule that holds."""
    return F.coalesce(*[F.when(bad, F.lit(message)) for bad, message in rules], F.lit(otherwise))


def all_blockers(*rules: tuple[Column, str]) -> Column:
    """The messages of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(message)) for bad, message in rules]))


def holds(text: Column, needles: list[str]) -> Column:
    """Whether the text holds any of the needles."""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def labelled_share(text: Column, marks: list[str]) -> Column:
    """Share of the sentences, cut at full stops, that hold a mark; 0 where there are none."""
    parts = F.filter(F.transform(F.split(text, r"\.", -1), F.trim), lambda p: p != "")
    return F.when(F.size(parts) == 0, 0.0).otherwise(F.size(F.filter(parts, lambda p: holds(p, marks))) / F.size(parts))


def scalp_zone(channel: Column) -> Column:
    """Coarse zone of an electrode by the naming of the 10-20 system: lobe by letters, side of temporal ones by the last digit."""
    up, like = F.upper(channel), lambda p: F.rlike(channel, F.lit(p))
    starts = lambda p: F.rlike(up, F.lit(p))
    side = F.when(like("[13579][^0-9]*$"), "temporal_left").when(like("[02468][^0-9]*$"), "temporal_right").otherwise("temporal_middle")
    return F.when(starts("^(T|FT|TP)"), side).when(starts("^[OI]"), "occipital").when(starts("^P"), "parietal").when(starts("^(C|FC)"), "central").when(starts("^(F|AF)"), "frontal")


def count_json_strings(json: Column, needles: list[str]) -> Column:
    """How many string values, at any depth of a JSON text, hold a needle."""
    text = r'"(?:[^"\\]|\\.)*"'
    values = F.regexp_extract_all(json, F.lit(rf":{text}|[\[,]{text}(?=[,\]])"), F.lit(0))
    return F.size(F.filter(values, lambda v: holds(v, needles)))


def ring_sum(values: str) -> Column:
    """Sum of the absolute steps around the ring of an array's values."""
    n = F.size(values)
    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.abs(F.get(values, i) - F.get(values, (i + 1) % n))), F.lit(0.0), lambda s, x: s + x)


def mean_pair_gap(values: str) -> Column:
    """Mean absolute difference over all pairs, from the sorted values: the i-th of n counts 2 i - n + 1 times."""
    n, ordered = F.size(values), F.array_sort(values)
    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ordered, i) * (2 * i - n + 1)), F.lit(0.0), lambda s, x: s + x)
    return total / (n * (n - 1) / 2)


def choose_three(n: Column) -> Column:
    """Number of triples among n."""
    return F.floor(n * (n - 1) * (n - 2) / 6).cast("long")


def even_grid(lo: Column, hi: Column, points: int) -> Column:
    """Array of evenly spaced points from lo to hi, both included."""
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: lo + (hi - lo) * i / (points - 1))
