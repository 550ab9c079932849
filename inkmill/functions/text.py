"""Text preparation, tokens and segments as Column expressions.

Patterns are written so that Java, RE2 and Python read them alike: classes of characters
are spelled out, and the detectors match on an ASCII copy of the text (`folded`).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space in Unicode text.
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same characters for Java: a character outside them is told from few comparisons, where ranges side by side are all tried.
_JAVA_SPACE = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F\x20\x85\xA0[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
_WHITE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# Fixed values, down to the functions: patterns that results must agree on.
#: A word: letters, digits and underscores, with apostrophes and hyphens inside.
TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
#: The first word and the second, if there is one.
FIRST_TWO = rf"(?s)\A.*?({TOKEN})(?:.*?({TOKEN}))?"
FRONT_MATTER = r"(?s)\A---\n.*?\n---\n"
FENCE = r"(?sm)^```.*?^```"
INLINE_CODE = r"`[^`\n]+`"
QUOTED = rf"(?m)^[{SPACE}]*>.*$"
HEADING = rf"(?m)^#{{1,6}}[{SPACE}].*$"
PARAGRAPH_BREAK = rf"\n[{SPACE}]*\n"
SENTENCE_END = r"(?<=[.!?])[\"')\]]* +"
#: Where lines of any convention end.
LINE_END = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
SUBJECT_MARKS = rf"\A[`#>*\-{SPACE}]+"
COURTESY = rf"(?i)\A[{SPACE}]*(?:here'?s?|here is|sure[,!]|certainly[,!]|of course[,!])[^\n]*\n+"
LEADING_HEADING = rf"\A#+[{SPACE}].*\n+"
BLOCK_END, LINE_BREAK, TAG, NUMBERED_ENTITY = r"(?i)</(?:p|div|li|h[1-6]|blockquote)>", rf"(?i)<br[{SPACE}]*/?>", "<[^>]+>", "&#[0-9]+;"


def unix(pattern: str) -> str:
    """The pattern for Java, with the newline as the only line end."""
    return pattern.replace(SPACE, _JAVA_SPACE).replace("(?sm)", "(?smd)").replace("(?s)", "(?sd)").replace("(?m)", "(?md)").replace("(?im)", "(?imd)").replace("(?i)", "(?id)")


def _drop(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, F.lit(unix(pattern)), F.lit(by))


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(_WHITE))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _where(step: tuple[str, ...], text: Column) -> Column:
    """_drop by (mark, pattern, replacement) on the texts that hold the mark, which every match of the pattern does."""
    return F.when(text.contains(step[0]), _drop(text, *step[1:])).otherwise(text)


def prose_scan(text: Column) -> Column:
    """Text without front matter, fenced and inline code and quoted lines; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for step in (("---", FRONT_MATTER), ("```", FENCE), ("`", INLINE_CODE, " "), (">", QUOTED)):
        out = F.transform(F.array(out), functools.partial(_where, step))[0]  # so that each step's text is bound once
    return out


def prose_style(text: Column) -> Column:
    """As prose_scan, without headings too."""
    return _drop(prose_scan(text), HEADING)


def folded(text: Column) -> Column:
    """An ASCII copy, one character for one: white space to blanks, other letters and digits to 0, the rest to #."""
    out = F.regexp_replace(text, F.lit(r"[\x0B\x1C\x1D\x1E\x1F\x85\xA0[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]]"), F.lit(" "))
    out = F.regexp_replace(out, F.lit(r"[[^\x00-\x7F]&&[\p{L}\p{N}]]"), F.lit("0"))
    return F.when(is_ascii(text), F.regexp_replace(text, F.lit(r"[\x0B\x1C-\x1F]"), F.lit(" "))).otherwise(F.regexp_replace(out, F.lit(r"[^\x00-\x7F]"), F.lit("#")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def blank_words(text: Column) -> Column:
    """The words that white space alone divides: another count than word_count."""
    return F.regexp_count(text, F.lit(unix(f"[^{SPACE}]+"))).cast("long")


def collapsed(text: Column) -> Column:
    return F.trim(_drop(text, f"[{SPACE}]+", " "))


def blocks(text: Column) -> Column:
    return F.transform(F.split(text, unix(PARAGRAPH_BREAK)), collapsed)


def _counted(segments: Column, least: int) -> Column:
    """(text, n) of the segments of so many words or more."""
    return F.filter(F.transform(segments, lambda s: F.struct(s.alias("text"), word_count(s).alias("n"))), lambda x: x["n"] >= least)


def counted_paragraphs(found: Column) -> Column:
    """The numbers of words of the paragraphs of blocks(…)."""
    return _counted(found, 5)["n"]


def counted_sentences(found: Column) -> Column:
    """The sentences of blocks(…), each with its number of words."""
    # F.trim itself would take a sentence's place for the characters to trim
    return F.flatten(F.transform(found, lambda p: _counted(F.transform(F.split(p, SENTENCE_END), lambda s: F.trim(s)), 2)))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines with five words or more."""
    return _counted(blocks(text), 5)["text"]


def sentences(text: Column) -> Column:
    """Sentences of two words or more; none crosses a blank line."""
    return counted_sentences(blocks(text))["text"]


#: Entities in the order in which they are replaced.
ENTITIES = (
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&mdash;", "—"),
    ("&ndash;", "–"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&hellip;", "..."),
)
SKIPPED_TAGS = ("script", "style", "nav", "header", "footer", "aside", "form")


def html_text(html: Column) -> Column:
    """The running text of a page: lines of more than eight words or with a sentence mark."""
    out = _drop(F.coalesce(html, F.lit("")), r"(?is)<(" + "|".join(SKIPPED_TAGS) + r")\b.*?</\1>", " ")
    out = _drop(_drop(_drop(out, BLOCK_END, "\n\n"), LINE_BREAK, "\n"), TAG, " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.replace(out, F.lit("­"), F.lit(""))
    out = _drop(_drop(_drop(out, NUMBERED_ENTITY, " "), "[ \t]+", " "), "\n{3,}", "\n\n")
    kept = F.filter(F.split(out, "\n"), lambda line: (blank_words(line) > 8) | F.regexp_like(line, F.lit("[.!?]")))
    return stripped(F.array_join(kept, "\n"))


def clipped(text: Column, limit: int, mark: str = "\n[...]") -> Column:
    """Text without runs of blank lines, cut at limit characters, with a mark where something is missing."""
    out = _drop(stripped(text), "\n{3,}", "\n\n")
    return F.when(F.length(out) > limit, F.concat(F.left(out, F.lit(limit)), F.lit(mark))).otherwise(out)


def without_preamble(text: Column) -> Column:
    """Generated text without a first line of courtesy and a leading heading."""
    return stripped(_where(("\n\n\n", "\n{3,}", "\n\n"), _drop(_drop(text, COURTESY), LEADING_HEADING)))


def subject_line(text: Column) -> Column:
    """The first line with something in it, without white space and marks of markdown around it; lines end in any convention."""
    first = F.split(_drop(text, rf"\A[{SPACE}]+"), LINE_END, 2)[0]  # line ends are white space, too
    return F.btrim(stripped(_drop(F.coalesce(first, F.lit("")), SUBJECT_MARKS)), F.lit("`"))


def content_id(url: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(url, 256), 1, digits)
