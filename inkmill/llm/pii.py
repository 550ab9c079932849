"""Personal data in texts: strict patterns, and boosted trees over loose candidates. DataFrame functions only.

The strict patterns give the base spans of the kinds email, ip, card and phone; a match
that fails its check is dropped and not tried again. Loose patterns of every kind propose
further candidates, which may overlap one another and what failed: runs of digits in card
and phone groups, also inside longer runs, masked or six-byte addresses, written-out email
addresses, and secrets behind a keyword or a known prefix. A candidate is described by its
format (lengths, shares of kinds of characters, separators, groups, checks) and its context
(words and characters around it). Gradient-boosted trees are trained here and compiled into
expressions: on candidates that a rule writes out with their labels, hard negatives such as
dates, versions, amounts and serial numbers among them, and on candidates harvested from a
bounded sample of the documents where a check digit or a range settles the label. A logistic
fit for each kind on the half kept back turns margins into probabilities, and a kind's
threshold is the lowest of these from which on PRECISION of that half is right. Of
candidates over it the most probable come first; each becomes a span unless a base span or
one chosen before overlaps it.

Matching positions come from the pieces between matches, so a text is cut once a pattern.
Patterns start only where a run of their characters starts, so long runs cost linear time.

Null and empty texts have no spans. Repeated rows get equal spans; an empty table gives no
rows; other columns are ignored. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm.store import documents, materialise

KINDS = ("email", "ip", "card", "phone", "secret")
#: As specified, with possessive repeats where nothing could be given back, and run starts where a match can only begin there.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_KEYWORD = r"(?i)(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)"
#: Loose patterns; what stands before a match is never part of it, and repeats are possessive or bounded.
CANDIDATES = {
    "secret": _KEYWORD + r"\x20?[=:]\x20?\x22?[A-Za-z0-9+/_-]{8,}+|(?:AKIA[0-9A-Z]{12,}+|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9_-]{20,}+)",
    "phone": r"(?<![0-9.])(?:\+[0-9]{1,3}[\x20.-]?|[0-9]{1,3}[\x20.-])?(?:\([0-9]{1,4}\)[\x20.-]?|[0-9]{2,5}[\x20.-])[0-9]{2,5}(?:[\x20.-][0-9]{2,5}){0,3}(?![0-9]|\.[0-9])|(?<![0-9+.-])\+?[0-9]{10,12}(?![0-9.])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20)[A-Za-z0-9-]{2,63}+(?:(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{2,63}+){1,4}+",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20./-]{1,2}[0-9]{4}[\x20./-]{1,2}[0-9]{4}[\x20./-]{1,2}[0-9]{4}|[0-9]{4}[\x20./-]{1,2}[0-9]{6}[\x20./-]{1,2}[0-9]{5}|[0-9]{13,19})(?![0-9])",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}(?:\[\.\]|\(\.\)|\x20?\.\x20?)){3}[0-9]{1,3}(?![0-9])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
}
PRECISION = 0.98
#: Candidates that the rule writes out, documents of the sample, boosting rounds and depth.
TRAINING, HARVESTED, ROUNDS, DEPTH = 6000, 4000, 12, 4
_AROUND = 12


def _matches(text: Column, pattern: str) -> Column:
    """start, end and text of each match, with what stands right before and behind it."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int,text:string,before:string,behind:string>>").alias("spans"))

    def step(state: Column, k: Column, m: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p[k])
        end = begin + F.length(m[k])
        span = F.struct(begin.alias("start"), end.alias("end"), m[k].alias("text"), F.right(p[k], F.lit(_AROUND)).alias("before"), F.left(p[k + 1], F.lit(_AROUND)).alias("behind"))
        return F.struct(end.alias("at"), F.array_append(state["spans"], span).alias("spans"))

    # the arrays are bound once, as elements of one outer array, so that they aren't computed for each match again
    bound = F.transform(F.array(F.struct(found.alias("m"), pieces.alias("p"))), lambda x: F.aggregate(
        F.sequence(F.lit(0), F.size(x["m"]) - 1), start, lambda s, k: step(s, k, x["m"], x["p"]), lambda s: s["spans"]
    ))
    return F.when(F.regexp_like(text, F.lit(pattern)), bound[0]).otherwise(F.array().cast("array<struct<start:int,end:int,text:string,before:string,behind:string>>"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, i, F.lit(1)).cast("int"))
    return F.aggregate(F.transform(F.reverse(each), lambda d, i: F.when(i % 2 == 1, doubled(d)).otherwise(d)), F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "")), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _count(pattern: str, m: Column) -> Column:
    return F.length(F.regexp_replace(m, f"[^{pattern}]", "")).cast("double")


def features(kind: str, m: Column, before: Column, behind: Column) -> list[Column]:
    """Format and context of a candidate, as doubles."""
    size = F.length(m).cast("double")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    seen = lambda on, pattern: yes(F.regexp_like(on, F.lit(pattern)))
    value = F.regexp_replace(m, r"^.*[=:]\x20?\x22?", "")
    digits, groups = F.regexp_replace(m, "[^0-9]", ""), F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    return [
        F.lit(float(KINDS.index(kind))), size, F.length(digits).cast("double"), F.length(digits) / size, _count("A-Z", m) / size, _count("a-z", m) / size, _count("\\x20().-", m),
        F.size(groups).cast("double"), F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"), seen(m, _KEYWORD), seen(m, "AKIA|gh[pousr]_|sk-"),
        F.size(F.array_distinct(F.split(value, ""))).cast("double") / F.greatest(F.length(value), F.lit(1)), F.length(value).cast("double"),
        _count("0-9", value) / F.greatest(F.length(value), F.lit(1)), seen(before, r"(?i)(?:tel|phone|call|fax|mobile|mail|card|visa|host|addr)"),
        seen(before, r"(?i)(?:version|isbn|no\.|page|date|serial|order|id|[a-z0-9$€#/+]$)"), seen(behind, r"^(?:[A-Za-z0-9%€$/]|\x20?(?:km|kg|eur|usd|%))"),
        seen(m, r"^(?:19|20)[0-9]{2}[-./][01][0-9][-./][0-3][0-9]"), seen(m, "[\\[({]"), yes(F.when(F.length(digits).between(12, 19), luhn(digits))),
        yes(F.forall(groups, lambda g: (F.length(g) < 4) & (F.coalesce(g.try_cast("int"), F.lit(999)) <= 255))), seen(m, "^\\+"), _count(":", m),
    ]


N_FEATURES = 23


def training_rows(spark: SparkSession, n: int = TRAINING) -> DataFrame:
    """Candidates with kind and label, written out by a rule from the row number: phones, secrets and addresses against dates, versions, amounts and plain words."""
    pick = lambda k, mod: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(mod))
    hexed = lambda k, size: F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{k}")), 256), 1, size)
    digits = lambda k, size: F.lpad(pick(k, 10**size).cast("string"), size, "0")
    word = lambda k: F.element_at(F.array(*map(F.lit, "thing reason number of the under little answer mention value".split())), (pick(k, 10) + 1).cast("int"))
    choice = lambda k, *options: F.element_at(F.array(*map(F.lit, options)), (pick(k, len(options)) + 1).cast("int"))
    sep, key = choice(1, "-", " ", "."), choice(2, "password", "token", "secret", "api_key")
    octet = lambda k: pick(k, 256).cast("string")
    check = lambda body: F.element_at(F.filter(F.array(*map(F.lit, range(10))), lambda d: luhn(F.concat(body, d.cast("string")))), 1)
    luhned = lambda body, off=0: F.concat(body, F.pmod(check(body) + off, F.lit(10)).cast("string"))
    joined = lambda by, *parts: F.concat(parts[0], *(x for p in parts[1:] for x in (by, p)))
    grouped = lambda d, by: joined(by, *(F.substring(d, 1 + 4 * k, 4) for k in range(4)))
    plain, text_ends = (" ", " ", "the ", "; "), (" ", ".", ", ", "***")
    true_card, false_card = (luhned(F.concat(F.lit("4"), digits(3, 7), digits(4, 7)), off) for off in (0, 1 + pick(9, 9)))
    rows = [
        ("phone", 1, F.concat(digits(3, 3), sep, digits(4, 3), sep, digits(5, 4)), ("tel ", "call ", "phone: ", " "), text_ends),
        ("phone", 1, F.concat(F.lit("("), digits(3, 3), F.lit(") "), digits(4, 3), sep, digits(5, 4)), ("tel ", "mobile ", " ", " "), text_ends),
        ("phone", 1, F.concat(F.lit("+"), pick(6, 99).cast("string"), F.lit(" ("), digits(3, 3), F.lit(") "), digits(4, 3), F.lit("-"), digits(5, 4)), plain, (" ", "%%%", " 190.1", "!!")),
        ("phone", 1, F.concat(F.lit("1"), sep, F.lit("800"), sep, digits(4, 3), sep, digits(5, 4)), ("call ", " ", "fax "), text_ends),
        ("phone", 1, F.concat(F.lit("+"), F.lit("4"), digits(3, 5), digits(4, 5)), ("tel ", " ", "call "), text_ends),
        ("phone", 0, F.concat(F.lit("20"), digits(3, 2), choice(7, "-", "."), F.lpad((1 + pick(4, 12)).cast("string"), 2, "0"), choice(7, "-", "."), F.lpad((1 + pick(5, 28)).cast("string"), 2, "0")), ("date ", "on ", " ", " "), (" ", ".", ", ")),
        ("phone", 0, F.concat(digits(3, 2), F.lit("."), digits(4, 2), F.lit("."), digits(5, 2)), ("version ", "no. ", "page ", " "), (" ", "%", " km")),
        ("phone", 0, F.concat(digits(3, 3), F.lit(" "), digits(4, 2), F.lit(" "), digits(5, 2)), ("$", "page ", "#", " "), (" kg", "%", " eur", " ")),
        ("phone", 0, F.concat(digits(3, 5), digits(4, 5)), ("order ", "id ", "#", " "), text_ends),
        ("phone", 0, F.concat(F.lit("978-"), digits(3, 2), F.lit("-"), digits(4, 4), F.lit("-"), digits(5, 2)), ("isbn ", " "), text_ends),
        ("phone", 0, F.concat(octet(3), F.lit("."), octet(4), F.lit("."), octet(5), F.lit("."), octet(6)), plain, text_ends),
        ("phone", 0, grouped(true_card, sep), ("card ", " ", "visa "), text_ends),
        ("secret", 1, F.concat(key, F.lit("="), hexed(6, 18)), (" ", ". "), (" ", ".")),
        ("secret", 1, F.concat(key, F.lit(' = "'), hexed(6, 40)), (" ", ". ", "the "), ('" ', '".', '"###')),
        ("secret", 1, F.concat(F.upper(key), F.lit(' = "'), F.upper(hexed(6, 40))), (" ", "!! "), ('"!!', '" ')),
        ("secret", 1, F.concat(choice(9, "AKIA", "AKIA"), F.upper(hexed(7, 16))), (" ", ". "), (" ", ".")),
        ("secret", 1, F.concat(choice(9, "ghp_", "sk-"), hexed(7, 36)), (" ", ". "), (" ", ".")),
        ("secret", 0, F.concat(key, F.lit(": "), word(8), word(9)), (" the ", ". "), (" ", ".")),
        ("secret", 0, F.concat(key, F.lit("="), F.lit("xxxxxxxxxxxx")), (" ", ". "), (" ", ".")),
        ("secret", 0, F.concat(key, F.lit(": "), word(8), F.lit("-"), word(9)), (" ", "a "), (" ", ",")),
        ("email", 1, F.concat(word(8), F.lit(" [at] "), word(9), F.lit(" [dot] com")), ("mail ", " "), (" ", ".")),
        ("email", 1, F.concat(word(8), digits(3, 2), F.lit(" at "), word(9), F.lit(" dot org")), ("mail ", " "), (" ", ".")),
        ("email", 1, F.concat(word(8), F.lit("(at)"), word(9), F.lit(".net")), ("mail ", " "), (" ", ".")),
        ("email", 0, F.concat(word(8), F.lit(" (at) "), word(9), F.lit("."), F.initcap(word(10))), (" the ", " "), (" ", ",")),
        ("email", 0, F.concat(word(8), F.lit(" at "), word(9), F.lit("."), F.initcap(word(10))), ("look ", "was "), (" ", ",")),
        ("card", 1, true_card, plain, text_ends), ("card", 1, grouped(true_card, sep), ("card ", " ", "visa "), text_ends),
        ("card", 0, false_card, plain, text_ends), ("card", 0, grouped(false_card, sep), ("serial ", " ", "id "), text_ends), ("card", 0, luhned(F.concat(digits(3, 9), digits(4, 9)), 3), ("id ", "#", " "), text_ends),
        ("ip", 1, F.concat_ws("[.]", octet(3), octet(4), octet(5), octet(6)), ("host ", " "), text_ends),
        ("ip", 1, F.concat_ws(":", *(F.substring(hexed(6, 32), 1 + 4 * k, 4) for k in range(8))), ("host ", "addr ", " "), text_ends),
        ("ip", 0, joined(choice(8, "[.]", " . "), octet(3), (256 + pick(4, 700)).cast("string"), octet(5), octet(6)), plain, text_ends),
        ("ip", 0, F.concat_ws(" . ", pick(3, 20).cast("string"), pick(4, 20).cast("string"), pick(5, 20).cast("string"), pick(6, 20).cast("string")), ("version ", "page ", " "), text_ends),
        ("ip", 0, F.concat_ws(":", *(F.substring(hexed(6, 32), 1 + 2 * k, 2) for k in range(6))), ("id ", "serial "), text_ends),
    ]
    choose = lambda k, options: F.element_at(F.array(*map(F.lit, options)), (pick(k, len(options)) + 1).cast("int"))
    which = pick(0, len(rows))
    made = F.lit(None)
    for k, (kind, label, text, before, behind) in enumerate(rows):
        one = F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), text.alias("text"), choose(11, before).alias("before"), choose(12, behind).alias("behind"))
        made = one if k == 0 else F.when(which == k, one).otherwise(made)
    return spark.range(0, n, 1, 4).select("id", made.alias("c")).select("id", "c.*")


def harvested_rows(docs: DataFrame, n: int = HARVESTED) -> DataFrame:
    """Candidates of a sample of about n rows of docs whose label a check settles: cards by their check digit, addresses by the range of their parts, dates as no phones.

    The sample is of the rows with a hash of the id under a bound, and never more than three times n.
    """
    bound = min(1 << 40, n * (1 << 40) // max(1, docs.count()))
    near = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < bound).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = materialise(near.limit(3 * n), "sample")
    out = None
    for kind in ("card", "ip", "phone"):
        m, digits = F.col("s.text"), F.regexp_replace("s.text", "[^0-9]", "")
        label = {
            "card": (F.length(digits).between(13, 19) & luhn(digits)).cast("int"), "ip": _valid("ip", m).cast("int"),
            "phone": F.when(F.regexp_like(m, F.lit(r"^(?:19|20)[0-9]{2}[-./][01][0-9][-./][0-3][0-9]$")) | (F.length(digits) < 7), F.lit(0)),
        }[kind]
        rows = sample.select("doc_id", F.explode(_matches(F.col("text"), CANDIDATES[kind])).alias("s")).where(~F.contains(m, F.lit("[")) & ~F.contains(m, F.lit(":")))
        rows = rows.select(F.abs(F.xxhash64("doc_id", "s.start")).alias("id"), F.lit(kind).alias("kind"), label.alias("label"), "s.text", "s.before", "s.behind").where("label is not null")
        out = rows if out is None else out.unionByName(rows)
    return out


class Trees:
    """Boosted trees as a sum of nested cases; for each kind, slope and bias of its calibration, and a threshold of the probability."""

    def __init__(self, trees: list, weights: list[float], calibration: dict[str, tuple[float, float]], thresholds: dict[str, float]):
        self.trees, self.weights, self.calibration, self.thresholds = trees, weights, calibration, thresholds

    def margin(self, x: list[Column]) -> Column:
        def of(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, threshold, left, right = node
            return F.when(x[feature] <= threshold, of(left)).otherwise(of(right))

        out = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            out = out + weight * of(tree)
        return out

    def probability(self, kind: str, margin: Column) -> Column:
        slope, bias = self.calibration[kind]
        return F.round(1 / (1 + F.exp(-(F.lit(slope) * margin + F.lit(bias)))), 9)


def _platt(margin: list[float], label: list[float]) -> tuple[float, float]:
    """Slope and bias of a logistic fit by Newton's method, to targets drawn in as there are few rows."""
    x, y = np.array(margin), np.array(label)
    up, down = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target, rows, w = np.where(y == 1, up, down), np.stack([x, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        w = w + np.linalg.solve((rows * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ rows + 1e-3 * np.eye(2), rows.T @ (target - p)).clip(-2, 2)
    return float(max(w[0], 1e-6)), float(w[1])


def train(spark: SparkSession, docs: DataFrame | None = None, n: int = TRAINING, rounds: int = ROUNDS, depth: int = DEPTH) -> Trees:
    """Trees from written-out candidates and, if there are docs, harvested ones. The half with odd ids calibrates; report holds what it gives there."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = training_rows(spark, n)
    if docs is not None:
        rows = rows.unionByName(harvested_rows(docs).select(*rows.columns))
    by_kind = None
    for kind in CANDIDATES:
        own = rows.where(F.col("kind") == kind).withColumn("x", F.array(*features(kind, F.col("text"), F.col("before"), F.col("behind")))).select("id", "kind", F.col("label").cast("double").alias("label"), "x")
        by_kind = own if by_kind is None else by_kind.unionByName(own)
    rows = materialise(by_kind, "candidates")
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=32, seed=7).fit(rows.where("id % 2 = 0").select("label", array_to_vector("x").alias("features")))

    def node(j):
        if j.getClass().getSimpleName() == "LeafNode":
            return float(j.prediction())
        return (int(j.split().featureIndex()), float(j.split().threshold()), node(j.leftChild()), node(j.rightChild()))

    trees = Trees([node(t._call_java("rootNode")) for t in model.trees], list(model.treeWeights), {}, {})
    # the bounded half of the training rows
    scored = rows.where("id % 2 = 1").select("kind", "label", trees.margin([F.col("x")[k] for k in range(N_FEATURES)]).alias("margin")).collect()
    trees.report = {}
    for kind in CANDIDATES:
        own = [(r["margin"], r["label"]) for r in scored if r["kind"] == kind]
        slope, bias = trees.calibration[kind] = _platt([m for m, _ in own], [y for _, y in own])
        ranked = sorted(((round(float(1 / (1 + np.exp(-(slope * m + bias)))), 9), y) for m, y in own), reverse=True)
        best, good, report = 2.0, 0.0, (0, 0)
        for k, (p, label) in enumerate(ranked):
            good += label
            if (k + 1 == len(ranked) or ranked[k + 1][0] < p) and good / (k + 1) >= PRECISION:
                best, report = p, (int(good), k + 1)
        trees.thresholds[kind] = best
        trees.report[kind] = {"positives": int(sum(y for _, y in ranked)), "candidates": len(ranked), "chosen": report[1], "right": report[0], "threshold": best}
    return trees


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end")))


_NAME = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), {0}.rank + 1)"


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', {_NAME.format('s')}, cast(s.start as string), cast(s.end as string))), ',')")


def _kept(text: Column, pattern: str, good) -> Column:
    return F.transform(F.filter(_matches(text, pattern), good), lambda s: s.dropFields("text", "before", "behind"))


def _scored(text: Column, trees: Trees, kind: str) -> Column:
    """The candidates over the kind's threshold, with the probability first and falling, for sorting."""

    def one(s: Column) -> Column:
        x = F.array(F.array(*features(kind, s["text"], s["before"], s["behind"])))  # bound once, as an element of an outer array
        p = F.transform(x, lambda f: trees.probability(kind, trees.margin([f[k] for k in range(N_FEATURES)])))[0]
        return F.struct((-p).alias("order"), s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"))

    return F.filter(F.transform(_matches(text, CANDIDATES[kind]), one), lambda c: c["order"] <= -trees.thresholds[kind])


def _checker(kind: str):
    return lambda s: _valid(kind, s["text"])


def find(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, counts of base spans, their digest and all spans of every row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    loose = {k: _scored(text, trees, k) for k in CANDIDATES}
    strict = {k: _kept(text, p, _checker(k)) for k, p in PATTERNS.items()}
    rows = docs.select("doc_id", *(c.alias(f"s_{k}") for k, c in strict.items()), *(c.alias(f"l_{k}") for k, c in loose.items()))
    rows = rows.select(
        "doc_id", *(F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in PATTERNS),
        F.array_sort(F.concat(*(_tagged(F.col(f"s_{k}"), k) for k in PATTERNS))).alias("base"), F.array_sort(F.concat(*(F.col(f"l_{k}") for k in CANDIDATES))).alias("more"),
    )
    clear = (
        "aggregate(more, base, (a, m) -> case when exists(a, b -> b.start < m.end and m.start < b.end) then a"
        " else array_append(a, named_struct('start', m.start, 'rank', m.rank, 'end', m.end)) end)"
    )
    rows = rows.withColumn("every", F.when(F.size("more") == 0, F.col("base")).otherwise(F.array_sort(F.expr(clear))))
    return rows.select("doc_id", *(f"n_{k}" for k in PATTERNS), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("every").alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every row of documents."""
    docs = documents(spark, sf_dir)
    return find(docs, train(spark, docs))
