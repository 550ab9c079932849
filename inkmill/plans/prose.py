"""Queries over documents and pages: preparation, counts, profiles, findings, rhythm, corpora.

The synthetic documents hold few of the patterns that are looked for. So the queries on
patterns read *drafts*: each document with a sentence or two of ours at its end, picked by
its number, the same in the oracle. Paragraph queries read line breaks as blank lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions import detectors as D
from inkmill.functions import text as T
from inkmill.functions.metrics import mtld as mtld_of
from inkmill.functions.metrics import rounded
from inkmill.operators import dataset, style, tells
from inkmill.plans import sqltext as S
from inkmill.sources import sinks
from inkmill.sources.scratch import spread, written

#: Our own sentences; each detector fires in one of them at least, some just under their thresholds.
SUFFIXES = (
    "",
    "\n\nIt is not just a tool — it's a habit — and not only a habit — but a craft. We delve into a vibrant realm, a testament to robust and pivotal work.",
    "\n\nI hope this helps! Let me know if you need more.\n\nCertainly! Great question, and you're absolutely right.",
    "\n\n## Why Every Team Should Measure Twice\n\n- **Speed**: up\n- **Cost**: down\n- **Trust**: steady\n\n🚀 ✅ → done",
    "\n\nThis could possibly, perhaps, arguably work. It may be fairly slow. As of my last update, only time will tell; the future looks bright.",
    "\n\nIn order to win, in terms of cost, when it comes to time, the plan serves as a base, stands as a guide and boasts a map, ensuring calm, reflecting care, marking a turn.",
    "\n\n“Quoted” ‘words’ “again” and from the first draft to the last one, from early sketches to final prints, from a small town to the wide sea.",
    "\n\n```\ncode — not prose\n```\n> quoted — line\n`inline — code` and **bold one** **bold two** **bold three** **bold four** remain.",
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def with_suffix(docs: DataFrame) -> DataFrame:
    """doc_id, author, the document with a suffix of ours as text, and the document as it is as original."""
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.pmod("doc_id", F.lit(len(SUFFIXES))) + 1).cast("int"))
    return docs.select("doc_id", F.col("source").alias("author"), F.concat("text", suffix).alias("text"), F.col("text").alias("original"))


def drafts(spark: SparkSession, sf_dir: str, original: bool = False) -> DataFrame:
    """doc_id, author and the document with a suffix of ours; with the document as it is, too, if original."""
    rows = with_suffix(documents(spark, sf_dir))
    return spread(rows if original else rows.drop("original"), "doc_id")


DRAFTS = f"(SELECT doc_id, source AS author, text || ([{', '.join(map(S.quoted, SUFFIXES))}])[(doc_id % {len(SUFFIXES)}) + 1] AS text FROM documents)"


def rough_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of which a third has line ends of two characters and a blank head, and a third white space outside ASCII around it."""
    text, third = F.col("text"), F.pmod("doc_id", F.lit(3))
    windows = F.concat(F.lit("\r\n\t "), F.replace(text, F.lit("\n"), F.lit("\r\n")), F.lit(" \r\n\n"))
    wide = F.concat(F.lit("\u00a0\u2028 "), text, F.lit("\u2003\x1f"))
    return drafts(spark, sf_dir).withColumn("text", F.when(third == 1, windows).when(third == 2, wide).otherwise(text))


ROUGH_DRAFTS = f"""(SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN chr(13) || chr(10) || chr(9) || ' ' || replace(text, chr(10), chr(13) || chr(10)) || ' ' || chr(13) || chr(10) || chr(10)
  WHEN 2 THEN chr(160) || chr(8232) || ' ' || text || chr(8195) || chr(31) ELSE text END AS text FROM {DRAFTS})"""
_WHITE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_ENDS = "".join(map(chr, (11, 12, 13, 28, 29, 30, 0x85, 0x2028, 0x2029)))
_LINES = f"string_split(translate(replace(text, chr(13) || chr(10), chr(10)), {S.quoted(_ENDS)}, repeat(chr(10), {len(_ENDS)})), chr(10))"
FIRST_LINE = f"coalesce(list_filter(list_transform({_LINES}, lambda l: trim(l, {S.quoted(_WHITE)})), lambda l: l <> '')[1], '')"


SUBJECT = f"trim(trim(ltrim({FIRST_LINE}, {S.quoted('`#>*-' + _WHITE)}), {S.quoted(_WHITE)}), '`')"


def spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, author and text, with a blank line for every line break."""
    return spread(documents(spark, sf_dir).select("doc_id", F.col("source").alias("author"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")), "doc_id")


SPACED = "(SELECT doc_id, source AS author, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)"


def tell_counts(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return D.counts(drafts(spark, sf_dir), *keep)


def scan_vs_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = written(tell_counts(spark, sf_dir, "doc_id", "author"), "counts")  # read twice, and counted once
    return tells.scan(counted, tells.profile(counted))


_PROFILE = f"SELECT author, key, sum(words)::BIGINT AS words, count(*) AS n_docs, {S.rate('sum(count)', 'sum(words)')} AS rate FROM counts WHERE words >= {tells.SAMPLE_WORDS} GROUP BY author, key"


def _scan_sql(own: bool) -> str:
    base = "LEFT JOIN own o ON o.author = c.author AND o.key = c.key" if own else ""
    rate_of = "o.rate" if own else "NULL::DOUBLE"
    one = lambda x: f"printf('%.1f/1k', round({x}, 1))"
    return f"""WITH counts AS MATERIALIZED ({S.counts(DRAFTS, "doc_id, author")}){f", own AS ({_PROFILE})" if own else ""},
    r AS (SELECT doc_id, c.author, c.key, label, gated, min_count, pos, count, floor, {S.rate("count", "c.words")} AS rate, {rate_of} AS own FROM counts c JOIN {S.registry()} ON c.key = registry.key {base} WHERE count > 0),
    a AS (SELECT *, CASE WHEN gated THEN greatest(floor, coalesce(own * {tells.HEADROOM}::DOUBLE, 0)) ELSE 0 END AS lim FROM r),
    f AS (SELECT *, CASE WHEN gated THEN greatest(floor, coalesce(round(own::DECIMAL(20, 2) * {tells.HEADROOM}::DECIMAL(4, 2), 2)::DOUBLE, 0)) ELSE 0 END AS allowed FROM a WHERE NOT gated OR (count >= min_count AND rate > lim))
    SELECT doc_id, author, key, label, count, rate, allowed,
      CASE WHEN NOT gated THEN 'never author voice' WHEN own IS NULL THEN {one("rate")} || ' vs floor ' || {one("lim")} ELSE {one("rate")} || ' vs author ' || {one("own")} END AS why,
      row_number() OVER (PARTITION BY doc_id ORDER BY round(rate - allowed, 2) DESC, pos) AS place FROM f"""


NO_MTLD = tuple(m for m in style.METRICS if m != "mtld")


def style_rows(spark: SparkSession, sf_dir: str, with_mtld: bool = False) -> DataFrame:
    return style.measured(spaced(spark, sf_dir), "doc_id", "author", with_mtld=with_mtld)


def style_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style.profile(written(style_rows(spark, sf_dir), "style"), NO_MTLD)


_MEASURED = S.measured(SPACED, "doc_id, author")
_TOKENS = f"list_transform({S.tokens(S.prose_style('text'))}, lambda t: lower(t))"
_MEASURED_WITH_MTLD = f"""SELECT * REPLACE (round(mtld, 1) AS mtld) FROM ({S.mtld("tk", ", ".join(("doc_id", "author", *NO_MTLD)))}
  FROM ({S.measured(f"(SELECT *, {_TOKENS} AS tk FROM {SPACED})", "doc_id, author, tk")})))"""


def _long(where: str, metrics: tuple[str, ...] = NO_MTLD, source: str = "m") -> str:
    return "SELECT doc_id, author, metric, value FROM (UNPIVOT (SELECT doc_id, author, " + ", ".join(f"{m}::DOUBLE AS {m}" for m in metrics) + f" FROM {source} WHERE {where}) ON {', '.join(metrics)} INTO NAME metric VALUE value)"


def _own(metrics: tuple[str, ...] = NO_MTLD, source: str = "m") -> str:
    return f"""long AS ({_long(f"words >= {style.SAMPLE_WORDS}", metrics, source)}),
  own AS (SELECT author, metric, round(sum(value::DECIMAL(22, 3))::DOUBLE / count(*), 3) AS mean, round(min(value), 3) AS lo, round(max(value), 3) AS hi, count(*) AS n_values,
    (SELECT count(*) FROM {source} WHERE {source}.author = l.author AND words >= {style.SAMPLE_WORDS}) AS n_samples FROM long l GROUP BY author, metric)"""


_STYLE_PROFILE = _own()


_FIRST = f"""f AS (SELECT * FROM m WHERE words >= {style.SAMPLE_WORDS}
    QUALIFY row_number() OVER (PARTITION BY author ORDER BY {", ".join(f"{c} NULLS FIRST" for c in ("doc_id", *style.METRICS))}) = 1)"""


def _values(rows: tuple) -> str:
    return ", ".join("(" + ", ".join(S.quoted(x) if isinstance(x, str) else f"{x}::DOUBLE" for x in row) + ")" for row in rows)


def _compare_sql(kind: str, metrics: tuple[str, ...] = NO_MTLD) -> str:
    """kind: range, single or floors."""
    checks = tuple((*c, style.FLOORS[c[0]]) for c in style.CHECKS)
    text = lambda x: f"printf('%.3f', {x})"
    own = "NULL::DOUBLE AS mean, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, NULL::BIGINT AS n_samples" if kind == "floors" else "own.mean, own.lo, own.hi, own.n_samples"
    known = "false" if kind == "floors" else "exists (SELECT 1 FROM own o WHERE o.author = v.author)"
    return f"""WITH m AS MATERIALIZED ({_MEASURED_WITH_MTLD if "mtld" in metrics else _MEASURED}), {_FIRST + ", " + _own(metrics, "f") if kind == "single" else _own(metrics)},
    v AS ({_long("true", metrics)}),
    w AS (SELECT v.doc_id, v.metric, v.value, {own}, {known} AS known FROM v {"" if kind == "floors" else "LEFT JOIN own ON own.author = v.author AND own.metric = v.metric"}),
    two AS (SELECT doc_id, w.metric, value, CASE
        WHEN n_samples >= 2 AND value < lo * {style.BELOW}::DOUBLE THEN label || ' falls below anything this author does'
        WHEN n_samples >= 2 AND value > hi * {style.ABOVE}::DOUBLE THEN label || ' exceeds anything this author does'
        WHEN n_samples < 2 AND value / mean < low THEN label || ' is well below the single sample available'
        WHEN n_samples < 2 AND value / mean > high THEN label || ' is well above the single sample available' END AS note,
      CASE WHEN n_samples >= 2 THEN {text("value")} || ' vs their observed ' || {text("lo")} || '-' || {text("hi")}
        ELSE {text("value")} || ' vs ' || {text("mean")} || ' (' || printf('%.2f', round(value / mean, 2)) || 'x) - one sample only, weak signal' END AS detail
      FROM w JOIN (VALUES {_values(style.MATCH)}) AS t(metric, low, high, label) ON t.metric = w.metric WHERE mean IS NOT NULL AND mean <> 0),
    one AS (SELECT doc_id, w.metric, value, why AS note, {text("value")} || ' vs ' || CASE WHEN nullif(mean, 0) IS NOT NULL THEN 'their ' || {text("mean")} ELSE 'floor ' || {text("floor")} END AS detail
      FROM w JOIN (VALUES {_values(checks)}) AS t(metric, side, factor, why, floor) ON t.metric = w.metric
      WHERE NOT (known AND w.metric IN ({", ".join(S.quoted(x[0]) for x in style.MATCH)}))
        AND CASE WHEN side = 'low' THEN value < coalesce(nullif(mean, 0) * factor, floor) ELSE value > coalesce(nullif(mean, 0) * factor, floor) END)
    SELECT * FROM two WHERE note IS NOT NULL UNION ALL SELECT * FROM one"""


def compare_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(style_rows(spark, sf_dir, with_mtld=True), "style")
    return style.compare(rows, style.profile(rows))


def compare_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(style_rows(spark, sf_dir, with_mtld=True), "style")
    return style.compare(rows, style.profile(style.first_samples(rows)))


def mtld(spark: SparkSession, sf_dir: str) -> DataFrame:
    prose = spread(documents(spark, sf_dir).select("doc_id", "text"), "doc_id").select("doc_id", T.prose_style(F.col("text")).alias("prose"))
    return prose.select("doc_id", mtld_of(F.transform(T.tokens(F.col("prose")), F.lower)).alias("v")).select("doc_id", rounded("v", 1).alias("mtld"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")


_PAGES = f"SELECT page_id, url, substr(sha256(url), 1, 16) AS cache_key, substr(sha256(url), 1, 12) AS id, text, {S.blank_words('text')}::BIGINT AS words FROM (SELECT page_id, url, {S.html_text('html')} AS text FROM pages)"
_STATUS = f"CASE WHEN words >= {dataset.CORPUS_WORDS} THEN 'ok' ELSE 'too short after extraction (' || words || ' words)' END"


def corpus_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = style.measured(spaced(spark, sf_dir), "doc_id", "author", with_mtld=False)
    return dataset.spread(style.long_form(rows, columns=NO_MTLD))


_SPREAD = f"""WITH m AS MATERIALIZED ({_MEASURED}), v AS ({_long("true")}),
  s AS (SELECT metric, count(*) AS n, list(value ORDER BY value) AS x FROM v GROUP BY metric)
SELECT metric, n, {", ".join(f"CASE WHEN n >= {dataset.LEAST_VALUES} THEN round({c}, 3) END AS {name}" for name, c in (
    ("min", "x[1]"), ("p10", "x[floor(n * 0.1)::INT + 1]"), ("median", "(x[(n - 1) // 2 + 1] + x[n // 2 + 1]) / 2"), ("p90", "x[least(n - 1, floor(n * 0.9))::INT + 1]"), ("max", "x[n]")))} FROM s"""
_EXCERPTS = f"""WITH p AS (SELECT page_id, list_transform(list_filter(string_split(text, chr(10)), lambda l: {S.blank_words("l")} > {dataset.PARAGRAPH_WORDS}), lambda l: regexp_replace(l, {S.quoted(rf"^[{T.SPACE}]+|[{T.SPACE}]+$")}, '', 'g')) AS ps FROM ({_PAGES})),
  n AS (SELECT page_id, ps, list_transform(ps, lambda l: {S.blank_words("l")}::BIGINT) AS ns FROM p WHERE len(ps) >= {dataset.LEAST_PARAGRAPHS}),
  i AS (SELECT page_id, ps, ns, start, k, list_sum(ns[start + 1:start + k])::BIGINT AS words, coalesce(list_sum(ns[start + 1:start + k - 1]), 0)::BIGINT AS before
    FROM n, unnest(range(1, least(len(ps) - 1, {dataset.STARTS}))) AS a(start), unnest(range(1, {dataset.PARAGRAPHS + 1})) AS b(k) WHERE start + k <= len(ps)),
  c AS (SELECT *, row_number() OVER (PARTITION BY page_id, start ORDER BY k DESC) AS r FROM i WHERE before < {dataset.TARGET_WORDS}),
  b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY abs(words - {dataset.TARGET_WORDS}), start) AS q FROM c WHERE r = 1 AND words >= {dataset.LEAST_SHARE} * {dataset.TARGET_WORDS})
SELECT page_id, start, words, array_to_string(ps[start + 1:start + k], chr(10) || chr(10)) AS text FROM b WHERE q = 1"""


def _sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_rows(spark, sf_dir).select("doc_id", "words", "sentences", "sent_len_mean", "sent_len_cv")


def _conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("role").alias("author"), "text")


_CONVERSATIONS = "(SELECT conv_id * 1000 + turn AS doc_id, role AS author, text FROM conversations)"

def caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under the vocabulary floor, and whether they are so short that this gives a direction only."""
    prose = spread(documents(spark, sf_dir).select("doc_id", "text"), "doc_id").select("doc_id", T.prose_style(F.col("text")).alias("prose"))
    rows = written(prose.select("doc_id", F.lit("").alias("author"), T.word_count(F.col("prose")).alias("words"), mtld_of(F.transform(T.tokens(F.col("prose")), F.lower)).alias("v")), "mtld")
    rows = rows.withColumn("mtld", rounded("v", 1))
    return style.caveats(rows, style.compare(rows, None, ("mtld",)))


def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of every page that is long enough; the others are counted by failure_counts."""
    texts = dataset.usable_pages(dataset.fetched(pages(spark, sf_dir))).select(F.col("page_id").alias("doc_id"), "url", "text")
    return style.measured(texts, "doc_id", "url", with_mtld=False)


def poles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by pole."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.when(F.col("quality") == 1, F.lit("exemplar-essay")).otherwise(F.lit("anti-exemplar")).alias("pole"))
    return rows.select("doc_id", "pole", dataset.pole_label(F.col("pole")).alias("label"))


QUERIES = {
    "word_counts": lambda s, d: documents(s, d).select("doc_id", T.word_count(F.col("text")).alias("words"), T.blank_words(F.col("text")).alias("blank_words")),
    "prepare_scan": lambda s, d: drafts(s, d).select("doc_id", F.md5(T.prose_scan(F.col("text"))).alias("prose_md5")),
    "prepare_style": lambda s, d: drafts(s, d).select("doc_id", F.md5(T.prose_style(F.col("text"))).alias("prose_md5")),
    "ascii_fold": lambda s, d: drafts(s, d).select("doc_id", F.md5(T.folded(F.col("text"))).alias("folded_md5")),
    "tell_counts_long": lambda s, d: tell_counts(s, d, "doc_id"),
    "tell_author_profile": lambda s, d: tells.profile(tell_counts(s, d, "author")),
    "tell_samples_used": lambda s, d: tells.samples_used(drafts(s, d), "author"),
    "tell_scan_no_baseline": lambda s, d: tells.scan(tell_counts(s, d, "doc_id", "author")),
    "tell_scan_vs_author": scan_vs_author,
    "tell_verdicts": lambda s, d: tells.verdicts(documents(s, d), scan_vs_author(s, d)),
    "tell_report": lambda s, d: sinks.report(tells.scan(tell_counts(s, d, "doc_id", "author"))),
    "tell_conversations": lambda s, d: D.counts(_conversation_rows(s, d), "doc_id", "author"),
    "sentence_stats": _sentence_stats,
    "paragraph_stats": lambda s, d: style_rows(s, d).select("doc_id", "paragraphs", "para_len_cv"),
    "repeated_openings": lambda s, d: style_rows(s, d).select("doc_id", "repeated_opening_rate"),
    "worst_openings": lambda s, d: style.worst_openings(spaced(s, d)),
    "flat_runs": lambda s, d: style_rows(s, d).select("doc_id", "longest_flat_run"),
    "mtld": mtld,
    "style_profile": style_profile,
    "mixed_register_warning": lambda s, d: style.mixed_registers(style_profile(s, d)),
    "style_compare_range": compare_range,
    "style_compare_single": compare_single,
    "style_caveats": caveats,
    "style_samples_used": lambda s, d: tells.samples_used(spaced(s, d), "author", style.SAMPLE_WORDS, T.word_count(T.prose_style(F.col("text")))),
    "corpus_rows": corpus_rows,
    "pole_labels": poles,
    "style_floors": lambda s, d: style.compare(style_rows(s, d), None, NO_MTLD),
    "html_text_words": lambda s, d: dataset.fetched(pages(s, d)).select("page_id", "cache_key", "id", "words", F.md5("text").alias("text_md5"), "status"),
    "failure_counts": lambda s, d: dataset.failure_counts(dataset.fetched(pages(s, d))),
    "corpus_spread": corpus_spread,
    "excerpts": lambda s, d: dataset.excerpts(dataset.fetched(pages(s, d)).select("page_id", "text")),
    "median_words": lambda s, d: dataset.upper_median(documents(s, d).select("lang", F.explode(F.array(T.blank_words(F.col("text")))).alias("words")), "lang", "words"),
    "clipped": lambda s, d: rough_drafts(s, d).select("doc_id", F.md5(T.clipped(F.col("text"), 2600)).alias("clip_md5"), F.md5(T.clipped(F.col("text"), 3000)).alias("feature_clip_md5")),
    "subject_lines": lambda s, d: rough_drafts(s, d).select("doc_id", T.subject_line(F.col("text")).alias("subject")),
    "generated_clean": lambda s, d: dataset.generated(drafts(s, d).select("doc_id", F.concat(F.lit("Sure, here it is:\n\n# A title\n"), "text").alias("text"))).select("doc_id", "words", "used", F.md5("text").alias("text_md5")),
}

_MTLD = f"{S.mtld('tk')} FROM (SELECT doc_id, list_transform({S.tokens('prose')}, lambda t: lower(t)) AS tk FROM (SELECT doc_id, {S.prose_style('text')} AS prose FROM documents)))"
_STRIP = rf"\A[{T.SPACE}]+|[{T.SPACE}]+\z"
ORACLES = {
    "word_counts": f"SELECT doc_id, {S.word_count('text')}::BIGINT AS words, {S.blank_words('text')}::BIGINT AS blank_words FROM documents",
    "prepare_scan": f"SELECT doc_id, md5({S.prose_scan('text')}) AS prose_md5 FROM {DRAFTS}",
    "prepare_style": f"SELECT doc_id, md5({S.prose_style('text')}) AS prose_md5 FROM {DRAFTS}",
    "ascii_fold": f"SELECT doc_id, md5({S.folded('text')}) AS folded_md5 FROM {DRAFTS}",
    "tell_counts_long": S.counts(DRAFTS, "doc_id"),
    "tell_author_profile": f"WITH counts AS ({S.counts(DRAFTS, 'doc_id, author')}) {_PROFILE}",
    "tell_samples_used": f"SELECT doc_id, author, words, words >= {tells.SAMPLE_WORDS} AS used FROM (SELECT doc_id, author, {S.word_count(S.prose_scan('text'))}::BIGINT AS words FROM {DRAFTS})",
    "tell_scan_no_baseline": _scan_sql(False),
    "tell_scan_vs_author": _scan_sql(True),
    "tell_verdicts": f"SELECT doc_id, count(key) AS n_findings, count(key) > 0 AS has_findings FROM documents LEFT JOIN ({_scan_sql(True)}) USING (doc_id) GROUP BY doc_id",
    "tell_report": f"SELECT doc_id, place, printf('  [%3dx] %-34s %s', count, label, why) AS line FROM ({_scan_sql(False)})",
    "tell_conversations": S.counts(_CONVERSATIONS, "doc_id, author"),
    "sentence_stats": f"SELECT doc_id, words, sentences, sent_len_mean, sent_len_cv FROM ({_MEASURED})",
    "paragraph_stats": f"SELECT doc_id, paragraphs, para_len_cv FROM ({_MEASURED})",
    "repeated_openings": f"SELECT doc_id, repeated_opening_rate FROM ({_MEASURED})",
    "worst_openings": f"""SELECT * FROM (SELECT doc_id, opening, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, opening DESC) AS place FROM (
      SELECT doc_id, opening, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(sents, lambda s: array_to_string(({S.tokens("lower(s)")})[1:2], ' '))) AS opening
        FROM (SELECT doc_id, {S.sentences("prose")} AS sents FROM (SELECT doc_id, {S.prose_style("text")} AS prose FROM {SPACED})) WHERE len(sents) >= 4)
      GROUP BY doc_id, opening HAVING count(*) > 1)) WHERE place <= 3""",
    "flat_runs": f"SELECT doc_id, longest_flat_run FROM ({_MEASURED})",
    "mtld": f"SELECT doc_id, round(mtld, 1) AS mtld FROM ({_MTLD})",
    "style_profile": f"WITH m AS MATERIALIZED ({_MEASURED}), {_STYLE_PROFILE} SELECT author, metric, mean, lo, hi, n_values, n_samples FROM own",
    "mixed_register_warning": f"WITH m AS MATERIALIZED ({_MEASURED}), {_STYLE_PROFILE} SELECT author, lo, hi, lo > 0 AND hi / nullif(lo, 0) > {style.MIXED} AS mixed FROM own WHERE metric = 'sent_len_mean'",
    "style_compare_range": _compare_sql("range", style.METRICS),
    "style_compare_single": _compare_sql("single", style.METRICS),
    "style_caveats": f"SELECT doc_id, words, words < {style.SHORT} AS directional FROM ({_MTLD}) JOIN (SELECT doc_id, {S.word_count(S.prose_style('text'))}::BIGINT AS words FROM documents) USING (doc_id) WHERE round(mtld, 1) < {style.FLOORS['mtld']}",
    "style_samples_used": f"SELECT doc_id, author, words, words >= {style.SAMPLE_WORDS} AS used FROM (SELECT doc_id, author, {S.word_count(S.prose_style('text'))}::BIGINT AS words FROM {SPACED})",
    "corpus_rows": S.measured(f"(SELECT page_id AS doc_id, url, text FROM ({_PAGES}) WHERE words >= {dataset.CORPUS_WORDS})", "doc_id, url"),
    "pole_labels": "SELECT doc_id, pole, CASE WHEN starts_with(pole, 'exemplar') THEN 1 ELSE 0 END::INT AS label FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'exemplar-essay' ELSE 'anti-exemplar' END AS pole FROM labels)",
    "style_floors": _compare_sql("floors"),
    "html_text_words": f"SELECT page_id, cache_key, id, words, md5(text) AS text_md5, {_STATUS} AS status FROM ({_PAGES})",
    "failure_counts": f"SELECT split_part({_STATUS}, ' ', 1) AS word, count(*) AS n FROM ({_PAGES}) GROUP BY ALL",
    "corpus_spread": _SPREAD,
    "excerpts": _EXCERPTS,
    "median_words": f"SELECT lang, count(*) AS n, list(words ORDER BY words)[count(*) // 2 + 1]::BIGINT AS upper_median FROM (SELECT lang, {S.blank_words('text')} AS words FROM documents) GROUP BY lang",
    "clipped": "SELECT doc_id, " + ", ".join(f"md5(CASE WHEN length(t) > {n} THEN left(t, {n}) || chr(10) || '[...]' ELSE t END) AS {name}" for n, name in ((2600, "clip_md5"), (3000, "feature_clip_md5"))) + f" FROM (SELECT doc_id, regexp_replace(trim(text, {S.quoted(_WHITE)}), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM {ROUGH_DRAFTS})",
    "subject_lines": f"SELECT doc_id, {SUBJECT} AS subject FROM {ROUGH_DRAFTS}",
    "generated_clean": f"SELECT doc_id, {S.blank_words('t')}::BIGINT AS words, {S.blank_words('t')} >= {dataset.GENERATED_WORDS} AS used, md5(t) AS text_md5 FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), {S.quoted(_STRIP)}, '', 'g') AS t FROM {DRAFTS})",
}
