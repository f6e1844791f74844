"""Personal data by weak supervision, in DataFrame expressions alone.

Patterns propose spans. Three labelers vote on each: a strict pattern with its
checks, a gazetteer of known prefixes and endings, and the words around the
span. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is; a logistic span classifier is fitted to the resulting
probabilities, again on counts. Spans of the strict patterns always stay; other
proposals stay if the classifier accepts them.

The counts have at most one row per kind, vote pattern and shape, so what comes
to the driver does not grow with the documents.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
# A run of local-part characters can only match from its start, or from where the last match ended.
STRICT = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?[(\[] ?(?:at|AT) ?[)\]] ?[A-Za-z0-9-]+(?: ?[(\[] ?(?:dot|DOT) ?[)\]] ?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])",
    "card": r"(?<![\w.+-])(?:3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}|[0-9]{4}(?:[ .-][0-9]{4}){3}|[0-9]{16})(?![\w]|[.-][0-9])",
    "phone": r"\+[0-9]{1,3} ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9-])|(?<![\w+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-]|\.[0-9])",
}
# A text in which these are missing has no match that passes; the check is one quick search.
_NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.contains("+"),
}
_LOOSE_NEEDS = {
    "email": lambda t: t.rlike(r"(?:at|AT) ?[)\]]"),
    "ip": lambda t: t.rlike(r"(?:[0-9A-Fa-f]{1,4}:){7}"),
    "card": lambda t: t.rlike(r"[0-9]{4}[ .-]?[0-9]{4}"),
    "phone": lambda t: t.rlike(r"[0-9]{3}[)]? ?[ .-]?[0-9]{3}[ .-][0-9]{4}"),
}
# Endings and prefixes that are in use, and words that announce a kind.
KNOWN = {
    "email": r"(?i)(?:\.|dot[)\]]? ?)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info|ch|at|it|nl|ca|us)$",
    "ip": r"^(?!0+\.)(?!127\.)(?!255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)",
    "phone": r"^\+?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\([2-9]|^[2-9]",
}
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write to|correo|courriel|kontakt)[^\n]{0,24}$",
    "ip": r"(?i)(?:\bip\b|host|server|address|adresse|direcci)[^\n]{0,24}$",
    "card": r"(?i)(?:card|visa|credit|karte|carte|tarjeta|payment)[^\n]{0,24}$",
    "phone": r"(?i)(?:phone|tel\b|tel\.|call|mobile|fax|telefon|t[eé]l[eé]phone|tel[eé]fono|anruf)[^\n]{0,24}$",
}
_SECRET = r"(?i)(?:token|secret|key|passw\w*|sha|hash|id|version|isbn)\W{0,4}$"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
LABELERS, OUTCOMES, SHAPES = 3, 3, 4
ACCEPT = 0.5
# For a span of its own kind, as kind, start and end in code points.
SPAN = "array<struct<kind:int,start:int,end:int>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the check sum."""

    def value(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((F.length(digits) - i) % 2 == 1, doubled).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(i))
    return (F.length(digits) > 0) & (total % 10 == 0)


def passes(kind: str, match: Column) -> Column:
    """The checks of a strict match."""
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    n = F.length(_digits(match))
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (text, start, end, before), with up to 40 characters before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(found.alias("m"), F.split(text, pattern, -1).alias("b"))
    empty = F.array().cast("array<struct<m:string,start:int,end:int,before:string>>")

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        row = F.struct(x["m"].alias("m"), start.alias("start"), end.alias("end"), F.right(x["b"], F.lit(40)).alias("before"))
        # behind the last match one piece is left without a match
        return F.when(x["m"].isNull(), state).otherwise(F.struct(end.alias("at"), F.concat(state["out"], F.array(row)).alias("out")))

    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.aggregate(pairs, first, add, lambda s: s["out"])


def _votes(kind: str, strict: bool, x: Column) -> Column:
    """A proposal with its votes: 0 against, 1 no opinion, 2 for."""
    m = x["m"]
    valid = passes(kind, m) if strict else (luhn(_digits(m)) if kind == "card" else F.lit(None).cast("boolean"))
    pattern = F.when(valid, 2).when(~valid, 0).otherwise(1) if strict or kind == "card" else F.lit(1)
    gazetteer = F.when(m.rlike(KNOWN[kind]), 2).otherwise(0)
    context = F.when(x["before"].rlike(_SECRET), 0).when(x["before"].rlike(CUES[kind]), 2).otherwise(1)
    shape = F.least(F.lit(SHAPES - 1), F.floor(F.length(m) / 8).cast("int"))
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
        pattern.cast("int").alias("v0"), gazetteer.cast("int").alias("v1"), context.cast("int").alias("v2"), shape.alias("shape"),
        F.lit(strict).alias("strict"),
    )


_PROPOSAL = "array<struct<kind:int,start:int,end:int,v0:int,v1:int,v2:int,shape:int,strict:boolean>>"


def proposals(text: Column) -> Column:
    """All proposals of a whole text with their votes; NULL texts have none."""
    empty = F.array().cast(_PROPOSAL)
    parts = []
    for strict, patterns, needs in ((True, STRICT, _NEEDS), (False, LOOSE, _LOOSE_NEEDS)):
        for kind in KINDS:
            voted = F.transform(located(text, patterns[kind]), partial(_votes, kind, strict))
            parts.append(F.when(needs[kind](text), voted.cast(_PROPOSAL)).otherwise(empty))
    return F.concat(*parts)


def base_spans(found: Column) -> Column:
    """Strict matches that pass their checks."""
    return F.filter(found, lambda x: x["strict"] & (x["v0"] == 2))


def _open(found: Column) -> Column:
    """Proposals outside the base: loose ones that overlap no base span of their kind."""
    base = base_spans(found)

    def free(x: Column) -> Column:
        return ~F.exists(base, lambda b: (b["kind"] == x["kind"]) & (b["start"] < x["end"]) & (x["start"] < b["end"]))

    return F.filter(found, lambda x: ~x["strict"] & free(x))


def estimate(rows: list[tuple[int, int, int, int, int, int]], rounds: int = 100) -> list[float]:
    """Chance that a vote pattern marks personal data, by expectation-maximisation.

    ``rows`` are (kind, three votes, shape, count). Each labeler has one table of
    vote chances per class, each kind a prior; pseudo-counts say that labelers
    are right more often than not, which fixes which class is which.
    """
    votes, n = np.array([r[1:4] for r in rows]), np.array([r[5] for r in rows], float)
    kind = np.array([r[0] for r in rows])
    belief = np.clip(0.5 + 0.2 * (votes - 1).sum(1), 0.05, 0.95)
    prior_counts = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])
    for _ in range(rounds):
        weight = np.stack([(1 - belief) * n, belief * n])
        share = np.array([(weight[1, kind == k].sum() + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))])
        log = np.stack([np.log(1 - share[kind]), np.log(share[kind])])
        for j in range(LABELERS):
            table = prior_counts + np.array([[weight[c, votes[:, j] == o].sum() for o in range(OUTCOMES)] for c in (0, 1)])
            log += np.log(table / table.sum(1, keepdims=True))[:, votes[:, j]]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        done = np.abs(new - belief).max() < 1e-9
        belief = new
        if done:
            break
    return belief.tolist()


def _inputs(row: tuple) -> list[float]:
    kind, votes, shape = row[0], row[1:4], row[4]
    return [float(kind == k) for k in range(len(KINDS))] + [float(v == o) for v in votes for o in (0, 2)] + [float(shape == s) for s in range(1, SHAPES)]


def train(rows: list[tuple[int, int, int, int, int, int]], ridge: float = 1.0) -> list[float]:
    """Weights of the span classifier, fitted to the estimated chances by Newton's method; zeros without rows."""
    width = len(KINDS) + 2 * LABELERS + SHAPES - 1
    if not rows:
        return [0.0] * width
    x, n = np.array([_inputs(r) for r in rows]), np.array([r[5] for r in rows], float)
    y, w = np.array(estimate(rows)), np.zeros(width)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(width), x.T @ (n * (p - y)) + ridge * w)
        size = np.abs(step).max()
        w -= step / max(1.0, size)
        if size < 1e-8:
            break
    return [float(v) for v in w]


def fit_pii(docs: DataFrame, text: str = "text") -> list[float]:
    """Classifier weights from the votes on all proposals in all documents."""
    each = docs.select(F.explode(F.filter(proposals(F.col(text)), lambda x: F.lit(True))).alias("p")).select("p.*")
    counted = each.groupBy("kind", "v0", "v1", "v2", "shape").count().orderBy("kind", "v0", "v1", "v2", "shape").collect()
    return train([tuple(r) for r in counted])


def chance(x: Column, weights: list[float]) -> Column:
    """The classifier's probability for one proposal."""

    def pick(field: str, values: dict[int, float]) -> Column:
        out = F.lit(0.0)
        for v, w in values.items():
            out = F.when(x[field] == v, F.lit(w)).otherwise(out)
        return out

    k = len(KINDS)
    z = pick("kind", dict(enumerate(weights[:k]))) + pick("shape", dict(enumerate(weights[k + 2 * LABELERS :], 1)))
    for j in range(LABELERS):
        z = z + pick(f"v{j}", {0: weights[k + 2 * j], 2: weights[k + 2 * j + 1]})
    return 1 / (1 + F.exp(-z))


def count_of(spans: str, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind)))


def written(spans: Column) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))


def find_pii(docs: DataFrame, weights: list[float] | None = None, text: str = "text") -> DataFrame:
    """Add ``base`` and ``spans``, arrays of (kind, start, end) in code points, end exclusive.

    ``weights`` come from ``fit_pii``; without them they are fitted to ``docs``.
    NULL and empty texts have empty arrays; repeated rows have equal ones. An
    empty table stays empty. Columns of these names are replaced.
    """
    own = fit_pii(docs, text) if weights is None else weights
    found = docs.withColumn("_found", proposals(F.col(text)))
    accepted = F.filter(_open(F.col("_found")), lambda x: chance(x, own) >= ACCEPT)
    base = base_spans(F.col("_found")).cast(_PROPOSAL)
    plain = lambda a: F.transform(a, lambda x: F.struct(x["kind"], x["start"], x["end"])).cast(SPAN)
    return found.withColumn("base", plain(base)).withColumn("spans", F.array_union(F.col("base"), plain(accepted))).drop("_found")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))

    def put(state: Column, s: Column) -> Column:
        gap = F.substr(text, state["at"] + 1, s["start"] - state["at"])
        fresh = F.struct((-s["less"]).alias("at"), F.concat(state["out"], gap, F.element_at(names, s["kind"] + 1)).alias("out"))
        return F.when(s["start"] >= state["at"], fresh).otherwise(F.struct(F.greatest(state["at"], -s["less"]).alias("at"), state["out"].alias("out")))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(ordered, first, put, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
