"""Assertions about outputs, and their pass rates.

Every assertion is a row; passed is null where a reader has to decide. Texts are matched on
their ASCII copy, as by the detectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions import matching as M
from inkmill.functions import text as T
from inkmill.functions.matching import times
from inkmill.functions.metrics import rounded
from inkmill.functions.similarity import token_similarity

# Words and patterns that outputs are graded by.
BANNED = "testament pivotal underscore underscores underscoring myriad seamless foster fostering intricate delve showcasing robust leveraged leveraging".split()
CHATBOT = (r"(?im)I hope this helps", r"(?im)Let me know if", r"(?im)feel free to", r"(?im)Would you like me to")
NEGATIVE = (r"(?im)not just\b[^.!?\n]{0,60}?\b(?:but|it'?s)", r"(?im)not only\b[^.!?\n]{0,60}?\bbut", r"(?im)not merely\b[^.!?\n]{0,60}?\b(?:but|it'?s)")
INLINE_BULLET = r"(?m)^[ \t]*[-*+][ \t]+\*\*[^*\n]+\*\*:"
BOLD = r"\*\*[^*\n]+\*\*"
PROCESS = (
    r"(?im)^#+\s*(?:sources?|references?|changes? made|what i changed)\b", r"(?im)\bI (?:searched|consulted|reviewed) (?:your|the user's)\b",
    r"(?im)^\s*\*\*(?:Sources?|References?|Changes?)\b",
)
CLAIMS = (
    r"(?im)\b(?:based on|matching|drawing on|consistent with) your (?:past |previous |prior )?(?:writing|messages|emails|updates|style)\b",
    r"(?im)\bI (?:found|reviewed|read) your (?:past|previous|prior)\b", r"(?im)\byour (?:past|previous) (?:writing|messages|updates) show\b",
)
LINK = r"(?:https?://|/Users/|slack\.com/archives|docs\.google\.com)"
ITEMS = {"dedupe": r"(?i)dedup|sync|duplicat", "retry": r"(?i)retr(?:y|ies)|webhook", "caching": r"(?i)cach|perf|faster|speed"}
REASON = r"(?i)weekend|saturday|sunday|on[- ]call|off the clock"
REVIEW = (
    r"(?im)don'?t rewrite", r"(?im)leave it (?:as|alone)", r"(?im)reads like you", r"(?im)^#+\s*(?:once[- ]over|review|notes|feedback)", r"(?im)^\s*(?:draft|current)\s*:",
    r"(?im)^>\s", r"(?im)\bsuggest\b", r"(?im)\bbefore you post\b", r"(?im)\bready to go\b",
)
YOU = r"(?i)\byou(?:'?re|'?ll|'?ve|r)?\b"
POINTS = (r"(?m)^#{2,}\s", r"(?m)^\s*[0-9]+[.)]\s", r"(?m)^\*\*[^*\n]+\*\*")


def found(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns occur."""
    return F.size(M.held(text, patterns))


def banned(text: Column) -> Column:
    names = F.array(*map(F.lit, BANNED))
    return F.transform(M.held(text, tuple(rf"(?i)\b{w}\b" for w in BANNED)), lambda k: names[k])


def lowercase_ratio(text: Column) -> Column:
    """The share of sentence starts of an ASCII copy that are in lower case; 0 without a start."""
    return M.lowercase_ratio(text)


def _rows(rows: DataFrame, checks: list[tuple[str, Column]], *keep: str) -> DataFrame:
    each = F.array(*(F.struct(F.lit(k).alias("site"), F.lit(name).alias("assertion"), c.cast("boolean").alias("passed")) for k, (name, c) in enumerate(checks)))
    return rows.select("run_id", "eval_id", *keep, F.explode(each).alias("a")).select("run_id", "eval_id", *keep, "a.site", "a.assertion", "a.passed")



def commit_message(rows: DataFrame) -> DataFrame:
    """Case 0. rows: (run_id, eval_id, text, clean: whether a scan finds nothing)."""
    rows = rows.withColumns({"plain": M.folded(F.col("text")), "subject": T.subject_line(F.col("text"))})
    first = F.regexp_extract("subject", r"\p{L}", 0)
    return _rows(rows, [
        ("subject_lowercase", F.regexp_like(first, F.lit(r"\p{Ll}"))), ("subject_no_period", ~F.endswith("subject", F.lit("."))), ("body_explains_why", F.lit(None)),
        ("no_process_leak", found(F.col("plain"), PROCESS) == 0), ("scan_clean", F.col("clean")),
    ])


def cleaned_draft(rows: DataFrame) -> DataFrame:
    """Case 1. rows: (run_id, eval_id, text)."""
    rows = rows.withColumn("plain", M.folded(F.col("text")))
    plain = F.col("plain")
    return _rows(rows, [
        ("vocabulary_removed", F.size(banned(plain)) == 0), ("signoff_removed", found(plain, CHATBOT) == 0), ("parallelism_removed", found(plain, NEGATIVE) == 0),
        ("bullets_removed", times(F.col("text"), INLINE_BULLET) == 0), ("em_dashes_kept", times(F.col("text"), "—") >= 2),
        ("habit_kept", (lowercase_ratio(plain) > 0.5) | (times(F.col("text"), BOLD) >= 2)), ("no_process_leak", found(plain, PROCESS) == 0),
        ("items_retained", found(plain, tuple(ITEMS.values())) == len(ITEMS)), ("imports_flagged", F.lit(None)),
    ])


def statement(rows: DataFrame) -> DataFrame:
    """Case 2. rows: (run_id, eval_id, text, clean)."""
    rows = rows.withColumn("plain", M.folded(F.col("text")))
    return _rows(rows, [
        ("no_sample_claims", found(F.col("plain"), CLAIMS) == 0), ("no_made_up_links", times(F.col("plain"), LINK) == 0), ("scan_clean", F.col("clean")),
        ("states_reason", times(F.col("plain"), REASON) > 0),
    ])


def once_over(rows: DataFrame, similarity: Column | None = None) -> DataFrame:
    """Case 3. rows: (run_id, eval_id, text, original). What was made, a review or a revision, decides which assertions hold.

    similarity: of text and original, where it is known already.
    """
    ratio = token_similarity(F.col("original"), F.col("text")) if similarity is None else similarity
    rows = rows.withColumn("similarity", ratio).withColumns({"plain": M.folded(F.col("text")), "plain_original": M.folded(F.col("original"))})
    plain, words = F.col("plain"), F.greatest(M.word_count(F.col("text")), F.lit(1))
    you = times(plain, YOU) * 1000.0 / words
    review = (F.col("similarity") < 0.4) & ((you >= 8.0) | (found(plain, REVIEW) >= 2))
    rows = rows.withColumn("review", review)
    quoted = F.array_join(F.regexp_extract_all(F.col("text"), F.lit(r"(?md)^>\s?(.*)$"), F.lit(1)), "\n")
    plain_quoted = M.folded(quoted)
    times_longer = M.blank_words(F.col("text")) / F.greatest(M.blank_words(F.col("original")), F.lit(1))
    points = times(plain, POINTS[0]) + times(plain, POINTS[1]) + times(plain, POINTS[2])
    only = lambda c: F.when(F.col("review"), c)
    never = lambda c: F.when(~F.col("review"), c)
    dashes = lambda c: times(F.col(c), "—")
    new_words = F.size(F.array_except(banned(plain), banned(F.col("plain_original"))))
    every = _rows(rows, [
        ("review_proportionate", only(times_longer < 2.5)),
        ("review_keeps_habits", only((F.trim(quoted) == "") | (times(quoted, "—") > 0) | (lowercase_ratio(plain_quoted) > 0.5))),
        ("review_few_points", only(points.between(1, 8))), ("review_correct", F.lit(None)),
        ("revision_keeps_wording", never(F.col("similarity") >= 0.5)), ("revision_keeps_dashes", never(dashes("text") >= F.greatest(F.lit(1), dashes("original") - 1))),
        ("revision_keeps_lowercase", never(lowercase_ratio(plain) >= lowercase_ratio(F.col("plain_original")) - 0.25)),
        ("nothing_introduced", (new_words == 0) & (times(F.col("text"), INLINE_BULLET) == 0)), ("mode_suits", F.lit(None)),
    ], "review")
    return every.where(
        F.when(F.col("review"), ~F.startswith("assertion", F.lit("revision_"))).otherwise(~F.startswith("assertion", F.lit("review_")))
    ).drop("review")


def rollup(expected: DataFrame, graded: DataFrame) -> DataFrame:
    """Passed, failed and manual assertions of every expected run; runs without output are MISSING. expected: (run_id, eval_id)."""
    auto = F.col("passed").isNotNull()
    by = graded.groupBy("run_id").agg(
        F.sum(F.coalesce(F.col("passed"), F.lit(False)).cast("long")).alias("passed"), F.sum((auto & ~F.col("passed")).cast("long")).alias("failed"),
        F.sum(auto.cast("long")).alias("total"), F.sum((~auto).cast("long")).alias("manual_pending"),
    )
    rate = rounded(F.coalesce(F.try_divide("passed", "total"), F.lit(0.0)), 4)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return expected.join(by, "run_id", "left").select(
        "run_id", "eval_id", zero("passed"), zero("failed"), zero("total"), F.when(F.col("total").isNotNull(), rate).alias("pass_rate"), zero("manual_pending"),
        F.when(F.col("manual_pending").isNull(), F.lit("MISSING")).otherwise(F.lit("graded")).alias("status"),
    )


def contract(specs: DataFrame, available: DataFrame, configs: DataFrame, only: list[int] | DataFrame | None = None) -> DataFrame:
    """Which declared files each run gets, and which are missing. specs: (eval_id, files), available: (file), configs: (config), only: case ids, or a table of them."""
    if isinstance(only, DataFrame):
        rows = specs.join(only.select("eval_id"), "eval_id", "left_semi")
    else:
        rows = specs if only is None else specs.where(F.col("eval_id").isin(only))
    wanted = rows.crossJoin(F.broadcast(configs)).select("eval_id", "config", F.explode_outer("files").alias("file"))  # a handful of configurations
    return wanted.join(available.withColumn("there", F.lit(True)), "file", "left").select("eval_id", "config", "file", F.col("file").isNull().alias("declares_none"), (F.col("file").isNotNull() & F.col("there").isNull()).alias("missing"))
