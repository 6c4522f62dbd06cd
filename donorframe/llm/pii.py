"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall generators (regular expressions run by the JVM) propose spans that may overlap; each span gets format
features (length, shares of digits and letters, hexadecimal, separators) and context features (key words before it,
quotes around it); boosted trees, written out as nested CASE expressions, score it; a calibrated threshold selects it.
Spans of the base kinds that pass their formal checks always stay. The trees are trained on the driver from a bounded
set of generated examples (TRAINING rows) with a held-out part that sets the threshold.

Positions: a pattern's matches and the text between them alternate, so starts are running sums of their lengths in code
points. Patterns are written so that the JVM needs no backtracking over long runs: a run is entered only at its start
(or at the end of the match before, `\\G`), and possessive where nothing follows that could take characters back.

What generators propose: a secret is a run of 20 or more of its characters with a digit among its first 65; context is the
CONTEXT characters before a span. A text without any digit or @ can hold no span of any kind.

Defined cases: very long texts are matched whole, in time that grows with their matches (times the logarithm); a null or empty text has no spans; null ids and repeated rows are kept; an empty table gives no rows;
other columns are ignored by find() and kept by redact().
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import unused
from .arrays import blocks, cut, let, scan

# Kinds in their order of listing.
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "id", "secret"]
#: Each with a cheap test of whether a text can hold it at all.
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){13}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
    "id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
    "secret": (r"(?:(?<![A-Za-z0-9+/_=-])|\G)(?=[A-Za-z+/_=-]{0,64}[0-9])[A-Za-z0-9+/_-]{20,}+=*+", r"[A-Za-z0-9+/_-]{20}"),
}
SECRET_WORDS = r"(?i)(token|secret|passw|api.?key|access.?key|credential|auth|private)[^\n]{0,16}$"
ID_WORDS = r"(?i)(ssn|social|security|tax|passport|identity)[^\n]{0,16}$"
CONTEXT = 32
TRAINING = 4_000
FEATURES = ["is_secret", "n_chars", "digits", "letters", "hexadecimal", "marks", "secret_words", "id_words", "quoted"]


def proposals(text: Column, kind: str) -> Column:
    """Array of (start, end, match, before, after) of a kind's generator."""
    pattern, test = PATTERNS[kind]
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind_of = "struct<start: int, end: int, match: string, before: string, after: string>"
    after = (lambda between, i: F.left(F.get(between, i + 1), F.lit(1))) if kind in ("id", "secret") else (lambda between, i: F.lit(""))

    def placed(both: Column) -> Column:
        # texts between matches and matches alternate, so ends are running sums of their lengths
        lengths = F.transform(both["m"], lambda m, i: F.length(F.get(both["b"], i)) + F.length(m))
        one = lambda m, i, end, b: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match"), F.right(b, F.lit(CONTEXT)).alias("before"), after(both["b"], i).alias("after"))
        return let(scan(lengths), lambda ends: F.transform(both["m"], lambda m, i: one(m, i, F.get(ends, i), F.get(both["b"], i))))

    found = let(F.struct(between.alias("b"), matches.alias("m")), placed)
    return F.when(text.rlike(test), found).otherwise(F.array().cast(f"array<{kind_of}>"))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of 14 to 19 digits passes Luhn's test."""

    def term(i: Column) -> Column:
        d = F.substr(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), term), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def formal(kind: str, match: Column) -> Column:
    """The formal check of a base kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # parts of any length: leading zeros do not count
        return F.forall(F.split(match, r"\.", -1), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(match, r"\.", -1), lambda p: F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.regexp_replace(p, "^0+(?=.)", "").cast("int") <= 255).otherwise(False))
    n = F.length(digits_of(match))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits_of(match))).otherwise(False)
    return n.between(10, 15)


def features(kind: str, s: Column) -> dict[str, Column]:
    n = F.length(s["match"])
    share = lambda pattern: F.length(F.regexp_replace(s["match"], pattern, "")) / n
    flag = lambda c: c.cast("double")
    return {
        "is_secret": F.lit(float(kind == "secret")), "n_chars": n.cast("double"), "digits": share("[^0-9]"), "letters": share("[^A-Za-z]"),
        "hexadecimal": flag(s["match"].rlike("^[0-9a-f]+$|^[0-9A-F]+$")), "marks": share("[A-Za-z0-9]"), "secret_words": flag(s["before"].rlike(SECRET_WORDS)),
        "id_words": flag(s["before"].rlike(ID_WORDS)), "quoted": flag(s["before"].rlike("[\"'`]$") & s["after"].rlike("^[\"'`]")),
    }


def training_rows(n: int = TRAINING) -> tuple[np.ndarray, np.ndarray]:
    """Generated candidates with labels: secrets and identity numbers in and out of telling context."""
    rng = random.Random(20240501)
    hexed, letters = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    mixed = letters + letters.upper() + "0123456789"
    rows, labels = [], []
    for _ in range(n):
        kind = rng.choice(["key", "key", "hash", "name", "number", "path", "ssn", "part"])
        context, quoted = 0.0, float(rng.random() < 0.2)
        ids = 0.0
        if kind in ("key", "hash"):
            pool = rng.choice([hexed, mixed])
            s = "".join(rng.choice(pool) for _ in range(rng.choice([20, 24, 32, 40, 64])))
            if kind == "key":
                context, quoted = 1.0, float(rng.random() < 0.7)
            good = kind == "key"
        elif kind == "name":
            s = "".join(rng.choice(letters) for _ in range(rng.randint(18, 40))) + str(rng.randint(0, 99))
            context, good = float(rng.random() < 0.1), False
        elif kind == "number":
            s, good = "".join(rng.choice("0123456789") for _ in range(rng.randint(20, 40))), False
            context = float(rng.random() < 0.05)
        elif kind == "path":
            s, good = "/".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(5)) + "/v2", False
            context = float(rng.random() < 0.1)
        else:
            s = f"{rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
            ids = 1.0 if kind == "ssn" else float(rng.random() < 0.002)
            good = kind == "ssn"
        size = len(s)
        rows.append([float(kind not in ("ssn", "part")), size, sum(c.isdigit() for c in s) / size, sum(c.isalpha() for c in s) / size, float(set(s) <= set(hexed)), sum(not c.isalnum() for c in s) / size, context, ids, quoted])
        labels.append(float(good))
    return np.array(rows), np.array(labels)


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients: a leaf's value, or (feature, cut, left, right)."""
    best, leaf = (1e-6, None), float(g.sum() / (h.sum() + 1))
    if depth:
        whole = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            cuts = np.unique(np.quantile((values[1:] + values[:-1]) / 2, np.linspace(0, 1, 9))) if len(values) > 1 else []
            for c in cuts:
                low = x[:, f] <= c
                gl, hl = g[low].sum(), h[low].sum()
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
                if gain > best[0]:
                    best = (gain, (f, float(c)))
    if best[1] is None:
        return leaf
    f, c = best[1]
    low = x[:, f] <= c
    return f, c, _tree(x[low], g[low], h[low], depth - 1), _tree(x[~low], g[~low], h[~low], depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, c, low, high = tree
    return np.where(x[:, f] <= c, _value(low, x), _value(high, x))


@lru_cache(maxsize=1)
def model(trees: int = 16, depth: int = 3, rate: float = 0.5, precision: float = 0.995) -> tuple[list, float]:
    """Boosted trees for the logistic loss, and the least margin whose held-out precision is reached."""
    x, y = training_rows()
    held = np.arange(len(x)) % 4 == 0
    margin, out = np.zeros(len(x)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _tree(x[~held], (y - p)[~held], (p * (1 - p))[~held], depth)
        out.append(tree)
        margin += rate * _value(tree, x)
    order = np.argsort(-margin[held], kind="stable")
    reached = np.cumsum(y[held][order]) / np.arange(1, held.sum() + 1) >= precision
    tied = np.append(np.diff(margin[held][order]) == 0, False)  # equal margins are selected together
    last = int(np.flatnonzero(reached & ~tied)[-1])
    return [(rate, t) for t in out], max(0.0, float(margin[held][order][last]))


def margin(feature: dict[str, Column]) -> Column:
    def walk(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        f, c, low, high = tree
        return F.when(feature[FEATURES[f]] <= c, walk(low)).otherwise(walk(high))

    total = F.lit(0.0)
    for rate, tree in model()[0]:
        total = total + rate * walk(tree)
    return total


def spans(text: Column) -> Column:
    """All selected spans in order: array of (start, rank of the kind, end, base)."""
    def chosen(rank: int, kind: str) -> Column:
        base = kind in BASE_KINDS
        ok = (lambda s: formal(kind, s["match"])) if base else (lambda s: margin(features(kind, s)) >= model()[1])
        return F.transform(F.filter(proposals(text, kind), ok), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(base).alias("base")))

    kept = [chosen(rank, kind) for rank, kind in enumerate(KINDS)]
    none = F.array().cast("array<struct<start: int, rank: int, end: int, base: boolean>>")
    return F.when(text.rlike("[0-9@]"), F.array_sort(F.concat(*kept))).otherwise(none)


def listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): counts per base kind, digest of the base spans and all spans."""
    slim = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = slim.select("doc_id", spans(F.col("text")).alias("found"))
    count = lambda r: F.size(F.filter("found", lambda s: s["rank"] == r)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)],
        F.sha2(listed(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The same documents with every span's text replaced by its kind in square brackets; overlapping spans become one.
    A null text stays null."""
    name = unused(docs, "found")
    work = docs.withColumn(name, F.when(F.col("text").isNotNull(), spans(F.col("text"))))
    text, names = F.col("text"), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    larger = lambda a, b: F.greatest(a, b)

    def clean(x: Column) -> Column:
        """Texts between spans, and the names of those spans that begin where all before them have ended."""
        told = F.transform(x["spans"], lambda s, i: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), F.coalesce(F.get(x["ends"], i - 1), F.lit(0)).alias("at")))
        fresh = F.filter(told, lambda s: s["start"] >= s["at"])
        return F.concat(F.array_join(F.transform(fresh, lambda s: F.concat(cut(x["cells"], s["at"], s["start"]), F.get(names, s["rank"]))), ""), cut(x["cells"], F.element_at(x["ends"], -1), x["n"]))

    ends = scan(F.transform(name, lambda s: s["end"]), larger)
    cleaned = let(F.struct(F.col(name).alias("spans"), ends.alias("ends"), blocks(text).alias("cells"), F.length(text).alias("n")), clean)
    return work.withColumn("text", F.when(F.size(name) > 0, cleaned).otherwise(text)).select(docs.columns)
