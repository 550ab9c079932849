"""Countable patterns of machine prose, each a Column over prepared text, and their thresholds.

`register_detector` adds one. A detector has a floor, the rate in 1,000 words over which it
is reported when nothing is known of the author, and a least count; an ungated detector
is reported whenever it occurs. Patterns of one detector are counted one by one and added.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType

from inkmill.functions import copies
from inkmill.functions.text import folded, prose_scan

# The word lists and patterns that results must agree on.
VOCABULARY = (
    "additionally align aligns aligned crucial delve delves emphasizing enduring enhance enhances enhancing foster fostering garner garnered "
    "highlighting interplay intricate intricacies pivotal showcase showcases showcasing tapestry testament underscore underscores underscoring "
    "vibrant seamless robust leverage leveraging myriad realm"
).split()
PARTICIPLES = (
    "highlighting underscoring emphasizing ensuring reflecting symbolizing contributing cultivating fostering encompassing showcasing solidifying cementing marking"
).split()
HEDGES = "could might may possibly potentially perhaps arguably somewhat relatively fairly seemingly generally typically".split()
SMALL_WORDS = "a an and the or of to in for on with at by from as is vs".split()

EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}\x{FE0F}]"
HEADING_LINE = r"(?m)^#{1,6}[ \t]+(.+)$"
#: key: (patterns on the text itself, patterns on its ASCII copy)
PATTERNS: dict[str, tuple[list[str], list[str]]] = {
    "em_dash": (["—"], [r"\s--\s"]),
    "curly_quotes": (["[“”‘’]"], []),
    "emoji": ([EMOJI], []),
    "bold": ([r"\*\*[^*\n]+\*\*"], []),
    "ai_vocab": ([], [r"(?i)\b(?:" + "|".join(VOCABULARY) + r")\b"]),
    "inline_header_bullets": ([r"(?m)^[ \t]*[-*+][ \t]+\*\*[^*\n]+\*\*:"], []),
    "negative_parallelism": ([], [
        r"(?i)\bnot just\b[^.!?\n]{0,60}?\b(?:but|it'?s|its)\b", r"(?i)\bnot only\b[^.!?\n]{0,60}?\bbut\b", r"(?i)\bnot merely\b[^.!?\n]{0,60}?\b(?:but|it'?s)\b",
        r"(?i)\bisn'?t just\b[^.!?\n]{0,60}?\b(?:it'?s|but)\b", r"(?i)\bno [a-z]+, no [a-z]+, just\b",
    ]),
    "copula_avoidance": ([], [r"(?i)\bserves? as\b", r"(?i)\bstands? as\b", r"(?i)\bboasts?\b", r"(?i)\brepresents? a\b", r"(?i)\bmarks? a\b"]),
    "participial_tail": ([], [r"(?i),\s+(?:" + "|".join(PARTICIPLES) + r")\b"]),
    "filler": ([], [
        r"(?i)\bin order to\b", r"(?i)\bdue to the fact that\b", r"(?i)\bat this point in time\b", r"(?i)\bin the event that\b", r"(?i)\bhas the ability to\b",
        r"(?i)\bhave the ability to\b", r"(?i)\bit is important to note that\b", r"(?i)\bit should be noted that\b", r"(?i)\bwhen it comes to\b", r"(?i)\bin terms of\b",
    ]),
    "chat_artifacts": ([], [
        r"(?im)\bI hope this helps\b", r"(?im)\bLet me know if you\b", r"(?im)^\s*Certainly[!,]", r"(?im)^\s*Of course[!,]", r"(?im)\bWould you like me to\b",
        r"(?im)\bHere'?s? (?:is )?a\b.{0,40}\bfor you\b", r"(?im)\bfeel free to (?:ask|reach out|let me know)\b",
    ]),
    "cutoff_disclaimer": ([], [
        r"(?i)\bas of my (?:last )?(?:training|update|knowledge)\b", r"(?i)\bwhile specific details are (?:limited|scarce|not)\b",
        r"(?i)\bbased on (?:the )?available information\b", r"(?i)\bmy training data\b", r"(?i)\bI don'?t have access to real[- ]time\b",
    ]),
    "sycophancy": ([], [
        r"(?i)\bGreat question\b", r"(?i)\bYou'?re absolutely right\b", r"(?i)\bThat'?s an excellent point\b", r"(?i)\bWhat a (?:great|fantastic)\b", r"(?i)\bExcellent question\b",
    ]),
    "generic_uplift": ([], [
        r"(?i)\bthe future looks bright\b", r"(?i)\bexciting times\b", r"(?i)\bjourney toward\b", r"(?i)\ba step in the right direction\b",
        r"(?i)\bcontinues to thrive\b", r"(?i)\bonly time will tell\b",
    ]),
    "false_range": ([], [r"(?i)\bfrom\s+(?:the\s+)?\w[\w\s'-]{2,30}?\s+to\s+(?:the\s+)?\w"]),
}
#: What every match of each pattern holds, in lower case, in the order of PATTERNS; "" where there is nothing of the kind.
GATES: dict[str, list[str]] = {
    "em_dash": ["—", "--"], "bold": ["**"], "inline_header_bullets": ["**"], "negative_parallelism": ["not just", "not only", "not merely", "t just", ", just"],
    "copula_avoidance": ["serve", "stand", "boast", "represent", "mark"], "participial_tail": [","],
    "filler": [
        "in order to", "due to the fact that", "at this point in time", "in the event that", "has the ability to", "have the ability to", "it is important to note that",
        "it should be noted that", "when it comes to", "in terms of",
    ],
    "chat_artifacts": ["i hope this helps", "let me know if you", "certainly", "of course", "would you like me to", "for you", "feel free to"],
    "cutoff_disclaimer": ["as of my", "while specific details are", "available information", "my training data", "have access to real"],
    "sycophancy": ["great question", "absolutely right", "an excellent point", "what a ", "excellent question"],
    "generic_uplift": ["the future looks bright", "exciting times", "journey toward", "a step in the right direction", "continues to thrive", "only time will tell"],
    "false_range": ["from"],
}
HEDGE = r"(?i)\b(?:" + "|".join(HEDGES) + r")\b"
WORD_ON_ASCII = r"\w(?:[\w'-]*\w)?"


@dataclass(frozen=True)
class Detector:
    key: str
    label: str
    gated: bool
    floor: float
    min_count: int
    column: Callable[[Column, Column], Column] | None


DETECTORS: dict[str, Detector] = {}


def register_detector(key: str, label: str, gated: bool, floor: float, min_count: int, column: Callable[[Column, Column], Column] | None) -> None:
    """column: (prepared text, its ASCII copy) to a count; None for those that `measured` counts."""
    DETECTORS[key] = Detector(key, label, gated, floor, min_count, column)


def _times(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(texts, pattern).to_numpy().astype(np.int64)


def _lowered(pattern: str) -> str:
    """The pattern for a lower-cased ASCII text, in which case needn't be ignored."""
    flags, body = ("", pattern) if not pattern.startswith("(?") or pattern[2] == ":" else pattern[2:].split(")", 1)
    return ("(?m)" if "m" in flags else "") + body.lower()


def _apart(pattern: str) -> str:
    """The pattern with what follows a match up to where the next can begin.

    Arrow goes on after a match as if the text began there. For patterns that begin and end with a word's bounds that is the
    same; one that begins a line takes the rest of it, one that ends within a word the rest of that.
    """
    return pattern + (r"[^\n]*" if pattern.startswith("(?m)^") else r"\w*" if pattern.endswith(r"\w") else "")


def _counted(texts: pa.Array, patterns: list[str], gates: list[str]) -> np.ndarray:
    """The matches of all patterns; of several, they run on the texts that hold what their matches hold."""
    if len(patterns) == 1:
        return _times(texts, _apart(patterns[0]))
    total = np.zeros(len(texts), np.int64)
    held = pc.match_substring_regex(texts, "|".join(map(re.escape, gates)))
    some, at = texts.filter(held), np.flatnonzero(held)
    if len(some):
        total[at] = sum(_times(some, _apart(p)) for p in patterns)
    return total


def _title_case(plain: pa.Array) -> np.ndarray:
    """Headings of three words or more besides small ones, of which enough after the first are capitalised."""

    def hit(line: str) -> bool:
        words = [w for w in re.findall(WORD_ON_ASCII, line, re.ASCII) if w.lower() not in SMALL_WORDS]
        capital = sum(re.match("[A-Z]", w) is not None and re.search("[a-z]", w) is not None for w in words[1:])
        return len(words) >= 3 and capital >= max(2, int((len(words) - 1) * 0.7))

    total = np.zeros(len(plain), np.int64)
    for k in np.flatnonzero(pc.match_substring_regex(plain, HEADING_LINE)):
        total[k] = sum(map(hit, re.findall(HEADING_LINE, plain[k].as_py())))
    return total


def _hedged(low: pa.Array) -> np.ndarray:
    """Sentences with three hedges or more."""
    hedge, total = re.compile(_lowered(HEDGE), re.ASCII), np.zeros(len(low), np.int64)
    for k in np.flatnonzero(_times(low, _lowered(HEDGE)) >= 3):
        total[k] = sum(len(hedge.findall(s)) >= 3 for s in re.split(r"(?<=[.!?])\s+", low[k].as_py(), flags=re.ASCII))
    return total


@arrow_udf(ArrayType(LongType()))
def measured(text: pa.Array) -> pa.Array:
    """The words of a text without code and quotations, and the counts of the detectors of this module in their order."""
    rows = []
    for texts in copies.blocks(text):
        prose = copies.prose_scan(texts)
        own, at = copies.folded(prose)
        plain = copies.as_texts(own, at)
        low = pc.ascii_lower(plain)
        found = [copies.word_counts(own, at)]
        for key in OWN:
            if key == "title_case_headings":
                found.append(_title_case(plain))
            elif key == "hedge_stack":
                found.append(_hedged(low))
            else:
                whole, folds = PATTERNS[key]
                gates = GATES.get(key, [])
                parts = ((prose, whole, gates[: len(whole)]), (low, list(map(_lowered, folds)), gates[len(whole) :]))
                found.append(sum(_counted(*part) for part in parts if part[1]))
        rows.append(np.stack(found, axis=1).ravel())
    width = len(OWN) + 1
    return pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(text) + 1, width, dtype=np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


# Labels, floors and least counts, in the order of the report.
for _key, _label, _gated, _floor, _least in (
    ("em_dash", "em dash density", True, 14.0, 4), ("curly_quotes", "curly quotes / apostrophes", True, 12.0, 5), ("emoji", "emoji", True, 2.0, 2),
    ("bold", "boldface density", True, 12.0, 4), ("ai_vocab", "AI vocabulary cluster", True, 9.0, 3), ("inline_header_bullets", "inline-header bullets", True, 3.0, 3),
    ("title_case_headings", "Title Case Headings", True, 2.0, 2), ("negative_parallelism", "negative parallelism", False, 0.0, 1),
    ("copula_avoidance", "copula avoidance", True, 4.0, 3), ("participial_tail", "participial '-ing' tails", True, 4.0, 2), ("filler", "filler phrases", True, 4.0, 3),
    ("hedge_stack", "stacked hedges", False, 0.0, 1), ("chat_artifacts", "assistant correspondence", False, 0.0, 1),
    ("cutoff_disclaimer", "knowledge-cutoff disclaimer", False, 0.0, 1), ("sycophancy", "sycophancy", False, 0.0, 1), ("generic_uplift", "generic uplift", True, 2.0, 1),
    ("false_range", "false ranges", True, 3.0, 2),
):
    register_detector(_key, _label, _gated, _floor, _least, None)
#: The detectors of this module, in the order of the counts that `measured` gives.
OWN = tuple(DETECTORS)


def registry(spark: SparkSession) -> DataFrame:
    """The detectors as a table: key, label, gated, floor, min_count and pos, their order."""
    rows = [(d.key, d.label, d.gated, d.floor, d.min_count, k) for k, d in enumerate(DETECTORS.values())]
    return spark.createDataFrame(rows, "key string, label string, gated boolean, floor double, min_count int, pos int")


def counts(docs: DataFrame, *keep: str) -> DataFrame:
    """One row a document and detector: the kept columns, words, key and count.

    The detectors of this module count in Arrow batches, those that were added in columns over the text
    and its ASCII copy. All is done before a row becomes one a detector, so that no later filter makes
    it be done anew.
    """
    prose, plain, n = F.col("prose"), F.col("plain"), F.col("n")
    prepared = docs.select(*keep, "text", measured("text").alias("n")).select(*keep, "text", F.explode(F.array("n")).alias("n"))
    if any(d.column is not None for d in DETECTORS.values()):
        prepared = prepared.select(*keep, "n", F.explode(F.array(prose_scan(F.col("text")))).alias("prose"))
        prepared = prepared.select(*keep, "n", "prose", F.explode(F.array(folded(prose))).alias("plain"))
    count = lambda d: n[OWN.index(d.key) + 1] if d.column is None else d.column(prose, plain).cast("long")
    pairs = F.array(*(F.struct(F.lit(d.key).alias("key"), count(d).alias("count")) for d in DETECTORS.values()))
    return prepared.select(*keep, n[0].alias("words"), F.explode(pairs).alias("c")).select(*keep, "words", "c.key", "c.count")
