"""REF/ALT classification and base arithmetic (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substitutions that count as transitions.
TRANSITIONS = ("A>G", "G>A", "C>T", "T>C")

# Two-base ambiguity codes, keyed by the sorted pair.
AMBIGUITY = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}

# Complement of each base, case kept.
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTNacgtn", "TGCANtgcan"


def is_snp(ref: Column, alts: Column) -> Column:
    first = F.get(alts, F.lit(0))
    return (F.length(ref) == 1) & (F.size(alts) == 1) & (F.length(first) == 1) & ~first.startswith("<")


def is_indel(ref: Column, alts: Column) -> Column:
    return F.exists(alts, lambda a: ~a.startswith("<") & (F.length(a) != F.length(ref)))


def is_anchored_indel(ref: Column, alt: Column) -> Column:
    """One allele is a prefix of the other, longer one."""
    return (
        ~alt.startswith("<")
        & (F.length(ref) != F.length(alt))
        & (F.startswith(ref, alt) | F.startswith(alt, ref))
    )


def infer_type(ref: Column, alt: Column, dialect: str = "summary") -> Column:
    """Type of one allele pair.

    ``summary`` tells INS from DEL, ``tags`` writes INDEL for both.
    """
    longer, shorter = ("INS", "DEL") if dialect == "summary" else ("INDEL", "INDEL")
    symbolic = alt.startswith("<") & alt.endswith(">")
    return (
        F.when(symbolic & (alt == "<DEL>"), shorter)
        .when(symbolic, "SYMBOLIC")
        .when((F.length(ref) == F.length(alt)) & (F.length(ref) == 1), "SNP")
        .when(F.length(ref) == F.length(alt), "MNP")
        .when(F.length(ref) < F.length(alt), longer)
        .otherwise(shorter)
    )


def substitution_class(ref: Column, alt: Column) -> Column:
    """``transition``, ``transversion`` or NULL for one REF/ALT pair."""
    single = (F.length(ref) == 1) & (F.length(alt) == 1)
    return (
        F.when(~single, F.lit(None))
        .when(F.concat(ref, F.lit(">"), alt).isin(*TRANSITIONS), "transition")
        .when(ref.isin(*"ACGT") & alt.isin(*"ACGT"), "transversion")
    )


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), COMPLEMENT_FROM, COMPLEMENT_TO)


def clean_bases(seq: Column) -> Column:
    """Upper case, U read as T, anything else than ACGTN read as N."""
    return F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGTN]", "N")


def ambiguity_code(a: Column, b: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in AMBIGUITY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.concat(F.least(a, b), F.greatest(a, b))), a)


def trimmed(ref: Column, alt: Column) -> Column:
    """Struct (skip, ref, alt): shared suffix removed first, then shared prefix, keeping one base each."""
    room = F.least(F.length(ref), F.length(alt)) - 1

    def shared(r: Column, a: Column, most: Column) -> Column:
        steps = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
        state = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))

        def step(s: Column, i: Column) -> Column:
            on = s["on"] & (F.substr(r, i, F.lit(1)) == F.substr(a, i, F.lit(1)))
            return F.struct((s["n"] + on.cast("int")).alias("n"), on.alias("on"))

        return F.aggregate(steps, state, step)["n"]

    def cut(tail: Column, head: Column) -> Column:
        return F.struct(
            head.alias("skip"),
            F.substr(ref, head + 1, F.length(ref) - tail - head).alias("ref"),
            F.substr(alt, head + 1, F.length(alt) - tail - head).alias("alt"),
        )

    # arrays of one element: a column that is used more than once would be computed for each use
    tails = F.array(shared(F.reverse(ref), F.reverse(alt), room))
    parted = F.transform(tails, lambda t: F.get(F.transform(F.array(shared(ref, alt, room - t)), lambda h: cut(t, h)), F.lit(0)))
    one = F.lit(1)
    differ = (F.right(ref, one) != F.right(alt, one)) & (F.left(ref, one) != F.left(alt, one))
    whole = (F.coalesce(room, F.lit(0)) <= 0) | F.coalesce(differ, F.lit(False))
    return F.when(whole, F.struct(F.lit(0).alias("skip"), ref.alias("ref"), alt.alias("alt"))).otherwise(F.get(parted, F.lit(0)))
