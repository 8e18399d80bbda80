"""Secret scans in built-in functions: three fixed patterns, and windows of high entropy in other strings.

Candidate strings are runs of at least `WINDOW` key characters with a digit among them. A window slides over a
candidate; the counts of its characters change by one in and one out, and the sum of c * log2(c) with them, which gives
the window's Shannon entropy. A candidate is a finding when its best window reaches the threshold of its character
class (hexadecimal digits, one letter case with digits, mixed) and no allow-list pattern covers it.

Defined results: a NULL text is the empty text and has no findings. Positions count code points, the end is exclusive.
Every row is treated by itself: repeated rows, ties and further columns pass through unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed patterns by kind, in the order of the kinds; group 2 of `assign` is the value.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
          r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of 20 characters or more: shorter runs fail as a whole
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

SPANS = "array<struct<start: int, rank: int, end: int, match: string>>"
BLOCK = 128  # matches that are walked at a time

WINDOW = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{{WINDOW},}}"
# Bits of a window of 20; random strings reach about 3.3, 3.8 and 4.1.
THRESHOLDS: Mapping[str, float] = {"hex": 2.9, "single": 3.4, "mixed": 3.7}
ALLOWED: Sequence[str] = (
    r"[0-9_/+-]+",  # numbers, dates, telephone numbers
    r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",  # UUID
    r"[A-Za-z]*[0-9]{0,4}([_/+-]+[A-Za-z]*[0-9]{0,4})*",  # words and short numbers, paths, names of versions
)


def found(text: Column, pattern: str, group: int, least: int, rank: int) -> Column:
    """(start, rank, end, match) of every match whose group has `least` characters.

    The pieces between matches give their places: match i starts after i + 1 pieces and i matches.
    """
    matches, groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(
        text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(matches.alias("m"), groups.alias("g"), F.split(text, pattern, -1).alias("p"))
    none = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["m"].alias("match"))
        keep = F.length(x["g"]) >= least
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], F.array(span)))
                        .otherwise(acc["spans"]).alias("spans"))

    def step_block(acc: Column, block: Column) -> Column:
        # The inner lambda binds the walked block, so that it is walked once.
        walked = F.aggregate(block, F.struct(acc["at"].alias("at"), none.alias("spans")), step)
        put = F.transform(F.array(walked), lambda w: F.struct(
            w["at"].alias("at"), F.concat(acc["parts"], F.array(w["spans"])).alias("parts")))
        return F.get(put, F.lit(0))

    def walked(pieces: Column) -> Column:
        """Matches are walked in blocks, so that a list is appended to at most `BLOCK` times and once a block."""
        count = F.floor((F.size(pieces) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count), lambda k: F.slice(pieces, k * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("parts"))
        return F.flatten(F.aggregate(blocks, start, step_block, lambda acc: acc["parts"]))

    return F.when(text.rlike(pattern), F.get(F.transform(F.array(zipped), walked), F.lit(0))).otherwise(none)


def best_entropy(value: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of all windows of an ASCII string; 0 for strings below a window."""
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c))
    powers = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])  # c * log2(c)

    def step(acc: Column, i: Column) -> Column:
        come = F.coalesce(F.get(acc["codes"], i), F.lit(0))
        leaves = i >= window
        gone = F.when(leaves, F.get(acc["codes"], i - window)).otherwise(F.lit(-1))
        n_in = acc["counts"][come]
        n_out = F.when(leaves, acc["counts"][F.greatest(gone, F.lit(0))] + (come == gone).cast("int")).otherwise(0)
        total = acc["total"] + powers[n_in + 1] - powers[n_in]
        total = total + F.when(leaves, powers[F.greatest(n_out - 1, F.lit(0))] - powers[n_out]).otherwise(0.0)
        counts = F.transform(acc["counts"], lambda c, k: c + (k == come).cast("int") - (k == gone).cast("int"))
        bits = F.when(i >= window - 1, math.log2(window) - total / window).otherwise(0.0)
        return F.struct(acc["codes"].alias("codes"), counts.alias("counts"), total.alias("total"),
                        F.greatest(acc["best"], bits).alias("best"))

    start = F.struct(codes.alias("codes"), F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"),
                     F.lit(0.0).alias("best"))
    places = F.sequence(F.lit(0), F.greatest(F.length(value) - 1, F.lit(0)))
    return F.aggregate(places, start, step, lambda acc: acc["best"])


def threshold(value: Column, thresholds: Mapping[str, float] = THRESHOLDS) -> Column:
    plain = F.regexp_replace(value, "[+/_-]", "")
    return (F.when(plain.rlike("^([0-9a-f]+|[0-9A-F]+)$"), thresholds["hex"])
            .when(plain.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), thresholds["single"]).otherwise(thresholds["mixed"]))


def high_entropy(text: Column, thresholds: Mapping[str, float] = THRESHOLDS,
                 allowed: Sequence[str] = ALLOWED) -> Column:
    listed = "^(" + "|".join(f"({p})" for p in allowed) + ")$"
    return F.filter(found(text, CANDIDATE, 0, WINDOW, KINDS.index("entropy")),
                    lambda s: ~s["match"].rlike(listed)
                    & (best_entropy(s["match"]) >= threshold(s["match"], thresholds)))


def scan(docs: DataFrame, text: str = "text", thresholds: Mapping[str, float] = THRESHOLDS,
         allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """Add `secrets`: an array of (start, rank, end, match), by start, then kind; a column of that name is replaced."""
    whole = F.coalesce(F.col(text), F.lit(""))
    spans = F.concat(found(whole, ASSIGN, 2, 6, 0), found(whole, ACCESS, 0, 20, 1), found(whole, HEX, 0, 24, 2),
                     high_entropy(whole, thresholds, allowed))
    return docs.withColumn("secrets", F.array_sort(spans))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", kinds[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by `mark`."""
    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(new, F.concat(acc["done"], piece)).otherwise(acc["done"]).alias("done"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(
        acc["done"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
