import time

from pyspark.sql import functions as F

from inkmill.functions import text as T


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


def test_preparation(spark):
    text = "---\ntitle: x\n---\nKeep `code` this.\n```\ngone\n```\nstill\n\n> quoted\n# Heading\nend\n```\nopen fence stays"
    assert one(spark, text, T.prose_scan) == "Keep   this.\n\nstill\n\n# Heading\nend\n```\nopen fence stays"
    assert "# Heading" not in one(spark, text, T.prose_style)
    assert one(spark, None, T.prose_scan) == ""


def test_tokens(spark):
    assert one(spark, "Don't re-do naïve 'quotes' -- _x_ 3.5", T.tokens) == ["Don't", "re-do", "naïve", "quotes", "_x_", "3", "5"]
    assert one(spark, "a  b c\x1cd", T.blank_words) == 4
    assert one(spark, "", T.word_count) == 0


def test_sentences_and_paragraphs(spark):
    text = 'He said "stop." Then he left! Why?\n\nA new (block.) begins here. Yes.'
    assert one(spark, text, T.sentences) == ['He said "stop."'.replace('."', "."), "Then he left!", "A new (block.", "begins here."]
    assert one(spark, text, T.paragraphs) == ['He said "stop." Then he left! Why?', "A new (block.) begins here. Yes."]


def test_sentences_keep_digits_at_their_ends(spark):
    text = "Five words are in here. 19.37.233.111\n\nThe year was 2. 2 of 2"
    assert one(spark, text, T.sentences) == ["Five words are in here.", "19.37.233.111", "The year was 2.", "2 of 2"]


def test_patterns_for_java_match_the_same_characters(spark):
    rows = spark.createDataFrame([(f"a{chr(k)}b",) for k in range(0x10000) if not 0xD800 <= k <= 0xDFFF], "c string")
    for pattern in (f"[{T.SPACE}]+", f"[^{T.SPACE}]+"):
        assert rows.where(F.regexp_count("c", F.lit(pattern)) != F.regexp_count("c", F.lit(T.unix(pattern)))).isEmpty()


def test_words_are_counted_in_time(spark):
    text, start = "sechs wörter einer längeren zeile hier " * 100_000, time.monotonic()
    assert one(spark, text, lambda c: T.blank_words(F.concat(*[c] * 8))) == 4_800_000
    assert time.monotonic() - start < 15


def test_fold_keeps_length(spark):
    text = "é— x😀½"
    assert one(spark, text, T.folded) == "0# x#0"


def test_html(spark):
    html = "<nav>menu</nav><p>One &amp;lt; two words here.</p><script>x()</script><div>short line</div><p>It ends&nbsp;so&#8217;s.</p>"
    assert one(spark, html, T.html_text) == " One < two words here.\n It ends so s.".strip()


def test_generated_and_subject(spark):
    assert one(spark, "Sure, here you go:\n\n# Title\nText.\n\n\n\nMore.", T.without_preamble) == "Text.\n\nMore."
    assert one(spark, "\n  ## `fix: the thing`  \nbody", T.subject_line) == "fix: the thing"
    assert one(spark, "a" * 20, lambda c: T.clipped(c, 5)) == "aaaaa\n[...]"
    assert one(spark, "\n\nhello\n\n", lambda c: T.clipped(c, 2600)) == "hello"
    assert one(spark, "\u00a0\x1fa\r\n\n\n\nb\t\u2028", lambda c: T.clipped(c, 2600)) == "a\r\n\nb"
    subjects = {"fix bug.\r\nbody": "fix bug.", "\t\nfix: it": "fix: it", "\x85\u2029 > * `a b ` \x0bc": "a b ", "": "", " \n ": ""}
    assert {x: one(spark, x, T.subject_line) for x in subjects} == subjects


def test_ends_are_trimmed_without_patterns(spark):
    """White space is taken from both ends from there, not by a pattern that is tried at each blank within."""
    white = T._WHITE
    assert one(spark, white + "a" + white + "b" + white, T.stripped) == "a" + white + "b" and one(spark, white, T.stripped) == "" and one(spark, None, T.stripped) is None
    assert one(spark, white + "# a\u00a0\x85b\n", T.subject_line) == "a" and one(spark, None, T.subject_line) == ""
    plan = spark.createDataFrame([("",)], "x string").select(T.stripped(F.col("x")))._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan.lower()
