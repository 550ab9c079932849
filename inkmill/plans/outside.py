"""Queries over what comes in and goes out: readers, sinks that are read back, reports, and judged rows without a judge.

Sinks write below the shared folder, as intermediate tables do, and the query reads what they wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions import text as T
from inkmill.functions.metrics import rounded
from inkmill.operators import dataset, fidelity, grading, pairwise, reports, style, taste
from inkmill.plans import judged, prose
from inkmill.plans import sqltext as S
from inkmill.sources import cache, fixtures, readers, sinks
from inkmill.sources.scratch import new_path, written
from inkmill.streaming.detect import stream_counts

def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' names, written as a text file each and read by a list of two paths."""
    path = new_path(spark, "texts")
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.concat("n_name", F.lit(" — é")).alias("value"))
    names.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    rows = readers.read_texts(spark, f"{path}/n_nationkey=[0-9]/*.txt", f"{path}/n_nationkey=[0-9][0-9]/*.txt")
    return rows.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"), "text")


def given_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the first document, as if the caller held it."""
    row = prose.documents(spark, sf_dir).agg(F.min("doc_id").alias("doc_id"), F.min_by("text", "doc_id").alias("text")).first()
    return readers.from_text(spark, row["text"], row["doc_id"]).select("doc_id", "text", T.word_count(F.col("text")).alias("words"), T.blank_words(F.col("text")).alias("blank_words"))


def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages fetched from a cache of those that were long enough."""
    path, rows = new_path(spark, "cache"), prose.pages(spark, sf_dir)
    ok = dataset.fetched(rows).where("status = 'ok'").select("url", "text")
    cache.store(ok, path)
    return cache.fetch(rows.select("page_id", "url"), path).select("page_id", "cache_key", "status", F.md5("text").alias("text_md5"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of drafts that come as a stream, as far as they are there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parque[t]")  # a pattern, as a stream takes no single file
    path, counts = new_path(spark, "stream"), stream_counts(prose.with_suffix(stream), "doc_id")
    sink = counts.writeStream.format("parquet").option("path", path).option("checkpointLocation", new_path(spark, "progress"))
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(path)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as sources, from a bare list and from an object that wraps it; a manifest is one small file."""
    source = F.struct(F.col("n_name").alias("author"), F.concat(F.lit("https://example.org/"), "n_nationkey").alias("url"), F.lit("essay").alias("genre"))
    listed = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.sort_array(F.collect_list(source)).alias("sources"))
    out = None
    for shape, text in (("bare", F.to_json("sources")), ("wrapped", F.to_json(F.struct("sources")))):
        path = new_path(spark, shape)
        listed.select(text.alias("value")).write.text(path)
        rows = readers.read_manifest(spark, path).select(F.lit(shape).alias("shape"), "author", "genre", "url", "why")
        out = rows if out is None else out.unionByName(rows)
    return out


def ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ladders written as JSON and read with their schema; one without the field "usable" counts as usable."""
    path = new_path(spark, "ladders")
    rows = judged.rungs(spark, sf_dir).groupBy("source_id", "usable").agg(F.sort_array(F.collect_list(F.struct("level", F.concat(F.lit("text "), "level").alias("text")))).alias("rungs"))  # five levels
    sinks.write_json(rows.withColumn("source_id", F.col("source_id").cast("string")), path)
    return pairwise.usable(spark.read.schema(readers.LADDER).json(path)).select("source_id", F.inline("rungs"))


def json_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style profile, written as JSON and read back."""
    path, own = new_path(spark, "profile"), prose.style_profile(spark, sf_dir)
    sinks.write_json(own, path)
    return spark.read.schema(own.schema).json(path).select(*own.columns)


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages, split into usable ones and failures: which of the two tables holds each."""
    ok, failed = new_path(spark, "pages"), new_path(spark, "failures")
    rows = dataset.fetched(prose.pages(spark, sf_dir)).select("page_id", "status")
    sinks.write_split(rows, "ok", ok, failed)
    return spark.read.schema(rows.schema).parquet(ok).select("*", F.lit("corpus").alias("place")).unionByName(spark.read.schema(rows.schema).parquet(failed).select("*", F.lit("failures").alias("place")))


def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments made in three runs: the first does a half, the second breaks before its commit, the third adds what is missing."""
    rows = judged.assigned(spark, sf_dir)
    sink = sinks.Resumable(spark, new_path(spark, "resumed"), "generator string, i long, mirrors long, brief long", ["generator", "mirrors"])
    sink.append(rows.where(judged.noise(F.col("generator"), F.col("mirrors")) < 0.5))
    sink.stage(rows, sink.runs())
    sink.append(rows)
    return sink.read()


def rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word rarity by a frequency table made up of the length and a hash of each word; a tenth of the words isn't in it."""
    counted = written(style.word_counts(prose.documents(spark, sf_dir)), "words")
    words = counted.select("word").distinct()
    made = words.select("word", F.when(judged.noise(F.col("word")) >= 0.1, rounded(8 - 0.5 * F.least(F.length("word"), F.lit(14)) + judged.noise(F.col("word")) * 0.5, 2)).otherwise(0.0).alias("zipf"))
    return style.rarity(counted, made)


_ZIPF = f"CASE WHEN {judged.noise_sql('word')} >= 0.1::DOUBLE THEN round(8 - 0.5::DOUBLE * least(length(word), 14) + {judged.noise_sql('word')} * 0.5::DOUBLE, 2) ELSE 0 END"


def graded_once_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All outputs as the fourth case, with similarities from a hash, so that both modes occur."""
    rows = judged.outputs(spark, sf_dir).withColumn("similarity", rounded(judged.noise(F.col("run_id"), F.lit("s")), 4))
    return grading.once_over(rows, F.col("similarity"))


def _once_over_sql(known: bool) -> str:
    """known: all outputs, with similarities from a hash; else those of the fourth case, with the tokens' similarity."""
    dash = lambda x: S.times(x, "—")
    banned = lambda x: "[" + ", ".join(f"regexp_matches({x}, {S.quoted(rf'(?i)\b{w}\b')})" for w in grading.BANNED) + "]"
    points = " + ".join(S.times("plain", p) for p in grading.POINTS)
    checks = (
        ("review_proportionate", f"{S.blank_words('text')}::DOUBLE / greatest({S.blank_words('original')}, 1) < 2.5"),
        ("review_keeps_habits", f"trim(quoted) = '' OR {dash('quoted')} > 0 OR {judged._ratio('plain_quoted')} > 0.5"),
        ("review_few_points", f"({points}) BETWEEN 1 AND 8"), ("review_correct", "NULL::BOOLEAN"), ("revision_keeps_wording", "similarity >= 0.5"),
        ("revision_keeps_dashes", f"{dash('text')} >= greatest(1, {dash('original')} - 1)"),
        ("revision_keeps_lowercase", f"{judged._ratio('plain')} >= {judged._ratio('plain_original')} - 0.25::DOUBLE"),
        ("nothing_introduced", f"len(list_filter(list_zip({banned('plain')}, {banned('plain_original')}), lambda z: z[1] AND NOT z[2])) = 0 AND {S.times('text', grading.INLINE_BULLET)} = 0"),
        ("mode_suits", "NULL::BOOLEAN"),
    )
    base = f"""SELECT *, {S.folded('text')} AS plain, {S.folded('original')} AS plain_original, {S.folded('quoted')} AS plain_quoted FROM (
      SELECT *, array_to_string(regexp_extract_all(text, '(?m)^>[ \t\n\r\f\x0b]?([^\n]*)$', 1), chr(10)) AS quoted
      FROM (SELECT run_id, eval_id, text, original, {f"""round({judged.noise_sql('run_id', "'s'")}, 4) AS similarity FROM {judged._OUTPUTS}""" if known else f"similarity FROM {judged._OUTPUTS} JOIN sim ON run_id = id"}))"""
    review = f"similarity < 0.4 AND ({S.times('plain', grading.YOU)}::DOUBLE * 1000.0 / greatest({S.word_count('text')}, 1) >= 8 OR {judged._found('plain', grading.REVIEW)} >= 2)"
    rows = " UNION ALL ".join(f"SELECT run_id, eval_id, {k} AS site, '{name}' AS assertion, {check} AS passed, review FROM o" for k, (name, check) in enumerate(checks))
    similar = "" if known else S.similarity(judged.OUTPUT_TOKENS + " WHERE eval_id = 3") + ", "
    return f"""WITH RECURSIVE {similar}o AS MATERIALIZED (SELECT *, {review} AS review FROM ({base}))
      SELECT run_id, eval_id, site::INT AS site, assertion, passed FROM ({rows}) WHERE NOT starts_with(assertion, CASE WHEN review THEN 'revision_' ELSE 'review_' END)"""


def generator_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The presence axis against each generator: AUC, the share under the axis' threshold, and that threshold."""
    scored = judged.scores(spark, sf_dir).where("axis = 'presence'")
    cut = taste.youden(scored, "axis").select("axis", "threshold")
    shares = scored.where("label = 0").join(F.broadcast(cut), "axis").groupBy("generator").agg(rounded(F.avg((F.col("p") < F.col("threshold")).cast("double")), 3).alias("rejected"), F.first("threshold").alias("threshold"))
    return reports.generator_report(judged.generator_auc(spark, sf_dir).select("generator", F.col("auc").alias("auc_vs_exemplars"), F.col("n_neg").alias("n")).join(shares, "generator"))


def ladder_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged.verdicts(spark, sf_dir).join(pairwise.accuracy(judged.debiased(spark, sf_dir), "formulation").select("formulation", "rank_accuracy"), "formulation")
    return reports.ladder_report(rows)


def fidelity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged.trials(spark, sf_dir)
    return reports.fidelity_report(fidelity.fidelity(rows, "label"), "label")


def rewrite_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = judged.answers(spark, sf_dir, "b"), judged.answers(spark, sf_dir, "a", 0.05)
    return reports.rewrite_report(taste.compare_axes(before, after), taste.lost(before, after))


def strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.bradley_terry(judged.debiased(spark, sf_dir), "source_id", "formulation")


def candidate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairwise.ranked(judged.debiased(spark, sf_dir).where("formulation = 'craft'").drop("formulation"), "source_id")
    return reports.ranking_report(rows, "source_id")


def _strengths_sql() -> str:
    """One step of the fixed point over the list of a ladder's levels, each of which met every other one once."""
    others = "list_sum(list_transform(range(1, len(lv) + 1), lambda j: CASE WHEN j = i THEN 0::DOUBLE ELSE 1 / (lv[i] + lv[j]) END))"
    new = f"list_transform(range(1, len(lv) + 1), lambda i: won[i] / {others})"
    return f"""st AS (SELECT source_id, formulation, list(level ORDER BY level) AS items, list(w ORDER BY level) AS won FROM
      (SELECT source_id, formulation, level, sum(w)::DOUBLE AS w FROM (SELECT source_id, formulation, low AS level, p AS w FROM deb UNION ALL SELECT source_id, formulation, high, 1 - p FROM deb) GROUP BY ALL) GROUP BY ALL),
    it AS (SELECT *, list_transform(won, lambda w: 1::DOUBLE) AS lv, 0 AS k FROM st
      UNION ALL SELECT source_id, formulation, items, won, list_transform(nx, lambda x: greatest(x / (list_sum(nx) / len(nx)), {pairwise.LEAST}::DOUBLE)), k + 1
        FROM (SELECT *, {new} AS nx FROM it WHERE k < {pairwise.ROUNDS})),
    bt AS (SELECT source_id, formulation, item, round(ln(x), 4) AS strength FROM (SELECT source_id, formulation, unnest(items)::INT AS item, unnest(lv) AS x FROM it WHERE k = {pairwise.ROUNDS}))"""


_PAIRS = judged._PAIRS.replace("cmp AS", "RECURSIVE cmp AS", 1)
_RANKED = f"WITH {_PAIRS}, {_strengths_sql()}, rkd AS (SELECT source_id, item, strength, row_number() OVER (PARTITION BY source_id ORDER BY strength DESC, item) AS place FROM bt WHERE formulation = 'craft')"
_STYLE_NOTES = prose._compare_sql("range")
_ORDER = "[" + ", ".join(S.quoted(m[0]) for m in (*style.MATCH, *style.CHECKS)) + "]"


def style_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prose.written(prose.style_rows(spark, sf_dir), "style")
    return reports.style_report(rows, style.compare(rows, style.profile(rows, prose.NO_MTLD), prose.NO_MTLD), True, style.worst_openings(prose.spaced(spark, sf_dir)))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of each region, written as a text and read as labelled candidates."""
    path, regions = new_path(spark, "candidates"), spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "\n").alias("value"))  # a handful a region
    nations.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    return readers.read_candidates(spark, [f"{r['r_name']}={path}/n_regionkey={r['r_regionkey']}/*.txt" for r in regions.collect()])  # the regions are few


def _authored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.documents(spark, sf_dir).select("doc_id", F.col("source").alias("author"), "text")


_COMMITS = f"""SELECT author, row_number() OVER (PARTITION BY author ORDER BY doc_id) - 1 AS place, {prose.SUBJECT.replace("(text,", "(lower(text),")} AS subject, trim(text, {S.quoted(prose._WHITE)}) AS body
  FROM (SELECT doc_id, source AS author, text FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= {fixtures.LATEST})"""


QUERIES = {
    "fixture_commits": lambda s, d: fixtures.commits(_authored(s, d)), "fixture_files": lambda s, d: fixtures.files(_authored(s, d)), "labelled_candidates": candidates,
    "cached_fetch": cached, "tell_stream": streamed,
    "text_files": text_files, "given_text": given_text, "manifest_sources": manifest, "ladder_rungs": ladders, "json_profile": json_profile, "failures_sink": failures, "resume_sink": resumed,
    "word_rarity": rarity, "once_over_by_similarity": graded_once_over, "generator_report": generator_lines, "ladder_report": ladder_lines, "fidelity_report": fidelity_lines,
    "rewrite_report": rewrite_lines, "weights_report": lambda s, d: reports.weights_report(judged.weights(s, d)), "style_report": style_lines,
    "rollup_report": lambda s, d: reports.rollup_report(judged.rollup(s, d)), "candidate_report": candidate_lines,
}

_GEN = f"""WITH sc AS MATERIALIZED (SELECT * FROM ({judged._scores_sql('id, label, generator', judged.answers_sql())}) WHERE axis = 'presence'), yd AS ({judged.ORACLES['youden']}), ga AS ({judged._GENERATOR_AUC}),
  rj AS (SELECT sc.generator, round(avg((p < yd.threshold)::INT::DOUBLE), 3) AS rejected, any_value(yd.threshold) AS threshold FROM sc JOIN yd ON yd.axis = 'presence' WHERE label = 0 GROUP BY sc.generator)
  SELECT row_number() OVER (ORDER BY auc DESC, generator) - 1 AS place, printf('%-20s%4d%8s%10.2f%7.2f', generator, n_neg, auc::VARCHAR, rejected, threshold) AS line FROM ga JOIN rj USING (generator)"""
_REWRITE = f"""WITH cp AS MATERIALIZED ({judged.ORACLES['rewrite_compare']}), ls AS ({judged.ORACLES['rewrite_losses']}),
  ln AS (SELECT id, 0 AS part, list_position([{', '.join(map(S.quoted, taste.AXES))}], axis) AS k, printf('%-12s%9.3f%9.3f%+9.3f', axis, before, after, delta) AS line FROM cp
    UNION ALL SELECT DISTINCT id, 1, 0, '  what the rewrite lost:' FROM ls
    UNION ALL SELECT id, 2, place, printf('    %-24s %.2f -> %.2f', key, before, after) FROM ls
    UNION ALL SELECT id, 3, 0, CASE WHEN bool_or(worse) THEN '  The rewrite scores lower on: ' || string_agg(axis, ', ' ORDER BY list_position([{', '.join(map(S.quoted, taste.AXES))}], axis)) FILTER (worse) || '.' ELSE {S.quoted(reports.NOT_LOWER)} END FROM cp GROUP BY id)
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY part, k) - 1 AS place, line FROM ln"""
_STYLE_REPORT = f"""WITH nt AS MATERIALIZED (SELECT *, list_position({_ORDER}, metric) AS pos FROM ({_STYLE_NOTES})), ms AS MATERIALIZED ({prose._MEASURED}), wo AS ({prose.ORACLES['worst_openings']}),
  ln AS (SELECT doc_id, 0 AS pos, 0 AS part, words || ' words, ' || sentences || ' sentences, {reports.MODES[True]}' AS line FROM ms
    UNION ALL SELECT doc_id, 0, 1, {S.quoted(reports.NOTHING)} FROM ms WHERE doc_id NOT IN (SELECT doc_id FROM nt)
    UNION ALL SELECT doc_id, pos, 0, '  ' || note FROM nt UNION ALL SELECT doc_id, pos, 1, '     ' || metric || ' = ' || detail FROM nt
    UNION ALL SELECT nt.doc_id, pos, 2, '     most repeated: ' || string_agg(CASE WHEN contains(opening, '''') THEN '"' || opening || '"' ELSE '''' || opening || '''' END || ' x' || n, ', ' ORDER BY place) FROM nt JOIN wo USING (doc_id) WHERE metric = 'repeated_opening_rate' GROUP BY ALL)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) - 1 AS place, line FROM ln"""
_FILES = f"""SELECT author, unnest([{{'name': 'history.md', 'text': '# ' || coalesce(author, '') || chr(10) || chr(10) || subjects || chr(10)}}, {{'name': 'draft.md', 'text': last || chr(10) || chr(10) || {S.quoted(fixtures.LOUD)}}},
  {{'name': 'notes.md', 'text': last || chr(10) || chr(10) || {S.quoted(fixtures.PLAIN)}}}]) AS f FROM (SELECT author, string_agg(subject, chr(10) ORDER BY place) AS subjects, arg_max(subject, place) AS last FROM ({_COMMITS}) GROUP BY author)"""
_CACHED = f"""WITH pg AS MATERIALIZED ({prose._PAGES}), ch AS (SELECT cache_key, min(text) AS text FROM pg WHERE words >= {dataset.CORPUS_WORDS} AND url IS NOT NULL GROUP BY cache_key)
  SELECT page_id, pg.cache_key, CASE WHEN ch.text IS NOT NULL THEN 'cached' WHEN url IS NULL THEN 'failed: no url' ELSE 'failed: not in the cache' END AS status, md5(ch.text) AS text_md5 FROM pg LEFT JOIN ch ON pg.cache_key = ch.cache_key"""
ORACLES = {
    "fixture_commits": _COMMITS,
    "fixture_files": f"SELECT author, f.name AS name, f.text AS text FROM ({_FILES})",
    "labelled_candidates": "SELECT r_name AS label, string_agg(n_name, chr(10) ORDER BY n_name) || chr(10) AS text FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name",
    "cached_fetch": _CACHED,
    "tell_stream": prose.ORACLES["tell_counts_long"],
    "text_files": "SELECT n_nationkey, n_name || ' — é' || chr(10) AS text FROM nation",
    "given_text": f"SELECT doc_id, text, {S.word_count('text')}::BIGINT AS words, {S.blank_words('text')}::BIGINT AS blank_words FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)",
    "manifest_sources": "SELECT shape, n_name AS author, 'essay' AS genre, 'https://example.org/' || n_nationkey AS url, NULL::VARCHAR AS why FROM nation, (VALUES ('bare'), ('wrapped')) s(shape)",
    "ladder_rungs": f"SELECT item_id::VARCHAR AS source_id, x::INT AS level, 'text ' || x AS text FROM benchmark, range({judged.RUNGS}) r(x) WHERE item_id % 9 <> 4",
    "json_profile": prose.ORACLES["style_profile"],
    "failures_sink": f"SELECT page_id, {prose._STATUS} AS status, CASE WHEN words >= {dataset.CORPUS_WORDS} THEN 'corpus' ELSE 'failures' END AS place FROM ({prose._PAGES})",
    "resume_sink": judged.ORACLES["negatives_assignment"],
    "word_rarity": f"""SELECT doc_id, round(sum(zipf::DECIMAL(10, 4) * n)::DOUBLE / sum(n), 2) AS zipf_mean FROM (SELECT doc_id, n, {_ZIPF} AS zipf FROM (
      SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, lower(unnest({S.tokens(S.prose_style('text'))})) AS word FROM documents) WHERE regexp_full_match(word, '\\p{{L}}+') GROUP BY ALL)) WHERE zipf > 0 GROUP BY doc_id""",
    "once_over_by_similarity": _once_over_sql(True),
    "assertions_once_over": _once_over_sql(False),
    "generator_report": _GEN,
    "ladder_report": f"WITH {judged._PAIRS}, {judged._ACCURACY}, {judged._WINS}, vd AS ({judged._VERDICT}) SELECT row_number() OVER (ORDER BY vd.adjacent_accuracy DESC, formulation) - 1 AS place, printf('%-12s %6.2f %9.2f %7.2f %8.2f  %s', formulation, rank_accuracy, vd.adjacent_accuracy, coalesce(mean_spearman, 0), coalesce(vd.position_bias, 0), verdict) AS line FROM vd JOIN acc USING (formulation)",
    "fidelity_report": f"WITH fe AS ({judged.ORACLES['fidelity_error']}) SELECT label, 0::BIGINT AS place, printf('  %-16s p=%.2f (sd %.2f, n=%d)  fidelity_error=%.2f', label::VARCHAR, mean_p, stdev, n, fidelity_error) AS line FROM fe UNION ALL SELECT label, 1, repeat(' ', 19) || direction FROM fe",
    "rewrite_report": _REWRITE,
    "weights_report": f"SELECT axis, place - 1 AS place, printf('  %-22s %+.3f', key, weight) || CASE WHEN disagrees THEN '   <- opposes its expected direction' ELSE '' END AS line FROM ({judged.ORACLES['weight_report']})",
    "style_report": _STYLE_REPORT,
    "rollup_report": f"SELECT run_id, printf('eval-%-23d', eval_id) || CASE WHEN status = 'MISSING' THEN '   MISSING' ELSE lpad(passed || '/' || total, 10, ' ') END AS line FROM ({judged.ORACLES['assertion_rollup']})",
    "candidate_report": f"{_RANKED} SELECT source_id, place - 1 AS place, printf('  %-18s %+.3f', item::VARCHAR, strength) AS line FROM rkd",
    # These queries are in judged.
    "bradley_terry": f"WITH {_PAIRS}, {_strengths_sql()} SELECT * FROM bt",
    "candidate_ranking": f"{_RANKED} SELECT * FROM rkd",
}
