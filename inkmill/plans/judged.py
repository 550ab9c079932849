"""Queries over judged inputs: the taste model, pairwise ranking, fidelity, grading, assignment.

What a judge or a generator would answer is an input. Here it is made up from the md5 of
the row's id and the question, the same in the oracles, leaning towards the label so that
models have something to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions import detectors as D
from inkmill.functions import text as T
from inkmill.functions.metrics import rounded
from inkmill.functions.similarity import token_similarity
from inkmill.operators import dataset, fidelity, grading, logistic, pairwise, taste, tells
from inkmill.plans import prose
from inkmill.plans import sqltext as S
from inkmill.sources import readers, sinks
from inkmill.sources.scratch import new_path, written

FORMULATIONS = ("plain", "reader", "craft", "editor", "specific")
GENERATORS, MODELS, RUNGS = 4, ("north/one", "north/two", "south/one", "west/one", "west/two", "east/one"), 5


def noise(*parts: Column | str) -> Column:
    """A number from 0 to 1 that depends on the parts only."""
    text = F.concat_ws("/", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("double") / 16777215.0


def noise_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('/', {', '.join(parts)})), 1, 6))::BIGINT::DOUBLE / 16777215.0::DOUBLE)"


def _answer(key: str, sign: int, salt: str, lean: float) -> Column:
    raw = 0.5 + sign * lean * (2 * F.col("label") - 1) + (noise(F.col("id"), key, salt) - 0.5) * 0.8
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4).alias(key)


def _answer_sql(key: str, sign: int, salt: str, lean: float) -> str:
    return f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + {sign} * {lean}::DOUBLE * (2 * label - 1) + ({noise_sql('id', S.quoted(key), S.quoted(salt))} - 0.5::DOUBLE) * 0.8::DOUBLE)), 4) AS {key}"


def answers(spark: SparkSession, sf_dir: str, salt: str = "", lean: float = 0.1) -> DataFrame:
    """id, label, generator (of label 0) and a column a dimension, of every row of labels."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    generator = F.when(F.col("label") == 0, F.concat(F.lit("gen"), F.pmod("id", F.lit(GENERATORS)).cast("string")))
    return rows.select("id", "label", generator.alias("generator"), *(_answer(k, sign, salt, lean) for k, sign, _ in taste.DIMENSIONS))


def answers_sql(salt: str = "", lean: float = 0.1) -> str:
    columns = ", ".join(_answer_sql(k, sign, salt, lean) for k, sign, _ in taste.DIMENSIONS)
    return f"(SELECT id, label, CASE WHEN label = 0 THEN 'gen' || (id % {GENERATORS}) END AS generator, {columns} FROM (SELECT doc_id AS id, quality AS label FROM labels))"


def _p_sql(axis: str) -> str:
    weights, bias = taste.AXES[axis]
    z = f"{bias!r}::DOUBLE" + "".join(f" + {w!r}::DOUBLE * {k}" for k, w in weights)
    return f"round(1 / (1 + exp(-greatest(-{taste.CLAMP}::DOUBLE, least({taste.CLAMP}::DOUBLE, {z})))), 6)"


def _scores_sql(keep: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{a}' AS axis, {_p_sql(a)} AS p FROM {source}" for a in taste.AXES)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taste.axis_scores(answers(spark, sf_dir), "id", "label", "generator")


_AUC = "((sum(CASE WHEN a.p > b.p THEN 2 WHEN a.p = b.p THEN 1 ELSE 0 END) * 2000 + 2 * count(*)) // (4 * count(*)))::DOUBLE / 1000"


def dimension_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimensions, with the mean answer on exemplars and on others, and whether these differ to the expected side."""
    each = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("decimal(22,4)").alias("value")) for k in taste.KEYS))
    long = answers(spark, sf_dir).select("label", F.explode(each).alias("a")).select("label", "a.*")
    of = lambda label: rounded(F.try_divide(F.sum(F.when(F.col("label") == label, F.col("value"))).cast("double"), F.sum((F.col("label") == label).cast("long"))), 6)
    means = long.groupBy("key").agg(of(1).alias("exemplars"), of(0).alias("others"))
    return taste.dimensions(spark).join(means, "key").withColumn("as_expected", F.signum(F.col("exemplars") - F.col("others")) == F.col("sign"))


def fitted(spark: SparkSession, sf_dir: str) -> tuple[tuple, float]:
    """Weights and bias fitted on the answers, to three places."""
    weights, bias = taste.fit(answers(spark, sf_dir))
    return tuple((k, round(w, 3)) for k, w in weights), round(bias, 3)


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published axes' weights and the fitted ones."""
    return taste.weight_report(spark, taste.AXES | {"fitted": fitted(spark, sf_dir)})


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted model, written as JSON with its axis unnamed, read back, and put to use on every row."""
    path, (weights, bias) = new_path(spark, "model"), fitted(spark, sf_dir)
    sinks.write_json(spark.createDataFrame([(None, [k for k, _ in weights], [w for _, w in weights], bias)], readers.MODEL), path)
    return taste.axis_scores(answers(spark, sf_dir), "id", "label", axes=readers.read_model(spark, path))


def generator_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The presence score of exemplars against each generator's texts."""
    rows = scores(spark, sf_dir).where("axis = 'presence'")
    gens = spark.createDataFrame([(f"gen{k}",) for k in range(GENERATORS)], "g string")
    both = rows.where("label = 1").crossJoin(F.broadcast(gens)).select("g", "p", "label")  # four generators
    return taste.auc(both.unionByName(rows.where("label = 0").select(F.col("generator").alias("g"), "p", "label")), "g").where("n_neg > 0").select(F.col("g").alias("generator"), "auc", "n_neg")


_GENERATOR_AUC = f"WITH s AS MATERIALIZED (SELECT * FROM ({_scores_sql('id, label, generator', answers_sql())}) WHERE axis = 'presence') SELECT b.generator, {_AUC} AS auc, count(DISTINCT b.id) AS n_neg FROM s a JOIN s b ON a.label = 1 AND b.label = 0 GROUP BY b.generator"


def rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five levels of every benchmark item; level 0 is the best."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("source_id"), F.when(F.col("item_id") % 9 == 4, F.lit(False)).alias("usable"))
    return items.crossJoin(spark.range(RUNGS).select(F.col("id").cast("int").alias("level")))  # five levels


def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, formulation, slot_a, slot_b and p_a: every pair of levels in both orders, and each level against itself twice."""
    r = pairwise.usable(rungs(spark, sf_dir))
    pairs = r.select("source_id", F.col("level").alias("slot_a")).join(r.select("source_id", F.col("level").alias("slot_b")), "source_id")
    names = spark.createDataFrame([(f, k) for k, f in enumerate(FORMULATIONS)], "formulation string, f int")
    turns = spark.range(2).select(F.col("id").cast("int").alias("turn"))
    every = pairs.crossJoin(F.broadcast(names)).crossJoin(F.broadcast(turns)).where("slot_a = slot_b or turn = 0")  # five formulations, two turns
    raw = 0.55 + 0.03 * F.col("f") + 0.1 * (F.col("slot_b") - F.col("slot_a")) + (noise(F.col("source_id"), F.col("formulation"), F.col("slot_a"), F.col("slot_b"), F.col("turn")) - 0.5) * 0.5
    return every.select("source_id", "formulation", "slot_a", "slot_b", "turn", rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4).alias("p_a"))


_FORMULATIONS = "(VALUES " + ", ".join(f"('{f}', {k})" for k, f in enumerate(FORMULATIONS)) + ") AS fo(formulation, f)"
_PAIRS = f"""cmp AS MATERIALIZED (SELECT item_id AS source_id, formulation, a.x AS slot_a, b.x AS slot_b, t.x AS turn, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    0.55::DOUBLE + 0.03::DOUBLE * f + 0.1::DOUBLE * (b.x - a.x) + ({noise_sql("item_id", "formulation", "a.x", "b.x", "t.x")} - 0.5::DOUBLE) * 0.5::DOUBLE)), 4) AS p_a
  FROM benchmark, range({RUNGS}) a(x), range({RUNGS}) b(x), range(2) t(x), {_FORMULATIONS} WHERE item_id % 9 <> 4 AND (a.x = b.x OR t.x = 0)),
  deb AS (SELECT f.source_id, f.formulation, f.slot_a AS low, f.slot_b AS high, round((f.p_a + (1 - r.p_a)) / 2, 6) AS p, round(abs(f.p_a - (1 - r.p_a)), 6) AS bias
    FROM cmp f JOIN cmp r ON f.source_id = r.source_id AND f.formulation = r.formulation AND f.slot_a = r.slot_b AND f.slot_b = r.slot_a WHERE f.slot_a < f.slot_b)"""
_ACCURACY = """acc AS (SELECT formulation, round(sum((p > 0.5)::INT)::DOUBLE / count(*), 3) AS rank_accuracy,
    round(sum(CASE WHEN high - low = 1 THEN (p > 0.5)::INT ELSE 0 END)::DOUBLE / greatest(sum((high - low = 1)::INT), 1), 3) AS adjacent_accuracy,
    round(sum(bias::DECIMAL(22, 6))::DOUBLE / count(*), 3) AS position_bias, count(*) AS comparisons FROM deb GROUP BY formulation)"""


def debiased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.debiased(comparisons(spark, sf_dir), "source_id", "formulation")


def win_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wins of each level, and its goodness by construction."""
    d = debiased(spark, sf_dir)
    one = d.select("source_id", "formulation", F.col("low").alias("level"), F.col("p").cast("decimal(22,6)").alias("w"))
    two = d.select("source_id", "formulation", F.col("high").alias("level"), (1 - F.col("p")).cast("decimal(22,6)").alias("w"))
    return one.unionByName(two).groupBy("source_id", "formulation", "level").agg(F.sum("w").alias("wins")).withColumn("good", -F.col("level"))


def rhos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.spearman(win_shares(spark, sf_dir), "good", "wins", "source_id", "formulation")


_WINS = """win AS (SELECT source_id, formulation, level, sum(w) AS wins FROM (SELECT source_id, formulation, low AS level, p::DECIMAL(22, 6) AS w FROM deb
    UNION ALL SELECT source_id, formulation, high, (1 - p)::DECIMAL(22, 6) FROM deb) GROUP BY ALL),
  rk AS (SELECT source_id, formulation, (2 * (rank() OVER (PARTITION BY source_id, formulation ORDER BY -level)) + count(*) OVER (PARTITION BY source_id, formulation, level) - 1)::BIGINT AS rx,
    (2 * (rank() OVER (PARTITION BY source_id, formulation ORDER BY wins)) + count(*) OVER (PARTITION BY source_id, formulation, wins) - 1)::BIGINT AS ry FROM win),
  rho AS (SELECT source_id, formulation, CASE WHEN count(*) >= 3 THEN round((count(*) * sum(rx * ry) - sum(rx) * sum(ry))::DOUBLE /
    nullif(sqrt(((count(*) * sum(rx * rx) - sum(rx) * sum(rx)) * (count(*) * sum(ry * ry) - sum(ry) * sum(ry)))::DOUBLE), 0), 3) END AS rho FROM rk GROUP BY ALL)"""
_VERDICT = """SELECT formulation, adjacent_accuracy, mean_spearman, position_bias, CASE WHEN mean_spearman IS NULL THEN 'no data'
  WHEN adjacent_accuracy >= 0.75 AND mean_spearman >= 0.9 AND position_bias < 0.35 THEN 'VALID' WHEN adjacent_accuracy >= 0.6 AND mean_spearman >= 0.7 THEN 'weak' ELSE 'FAILS' END AS verdict
  FROM acc JOIN (SELECT formulation, round(sum(rho::DECIMAL(22, 3))::DOUBLE / count(rho), 3) AS mean_spearman FROM rho GROUP BY formulation) USING (formulation)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = rhos(spark, sf_dir).groupBy("formulation").agg(rounded(F.try_divide(F.sum(F.col("rho").cast("decimal(22,3)")).cast("double"), F.count("rho")), 3).alias("mean_spearman"))
    rows = pairwise.accuracy(debiased(spark, sf_dir), "formulation").join(mean, "formulation")
    return rows.select("formulation", "adjacent_accuracy", "mean_spearman", "position_bias", pairwise.verdict(F.col("adjacent_accuracy"), F.col("mean_spearman"), F.col("position_bias")).alias("verdict"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trial a turn of conversations: label (of the conversation), i, which slot the real text had, and how sure the judge was of slot a."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.pmod("conv_id", F.lit(23)).alias("label"), (F.col("conv_id") * 1000 + F.col("turn")).alias("i"))
    rows = rows.withColumns({"real_is_a": fidelity.real_is_a(F.lit("11"), F.col("label").cast("string"), F.col("i").cast("string")), "prob_a": noise(F.col("i"), F.col("label"))})
    return rows.withColumns({"p_real": rounded(F.when(F.col("real_is_a"), F.col("prob_a")).otherwise(1 - F.col("prob_a")) * (0.6 + 0.03 * F.col("label")), 4), "held_id": F.pmod("i", F.lit(3))})


_COIN = "(('0x' || substr(md5(concat_ws('/', '11', label, i)), 1, 6))::BIGINT % 2 = 0)"
_TRIALS = f"""tr AS MATERIALIZED (SELECT *, round(CASE WHEN real_is_a THEN prob_a ELSE 1 - prob_a END * (0.6::DOUBLE + 0.03::DOUBLE * label), 4) AS p_real, i % 3 AS held_id FROM (
  SELECT label, i, {_COIN} AS real_is_a, {noise_sql("i", "label")} AS prob_a FROM (SELECT conv_id % 23 AS label, conv_id * 1000 + turn AS i FROM conversations)))"""


def voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(k,) for k in fidelity.LEVELS], "dimension string")
    rows = trials(spark, sf_dir).select("i").crossJoin(F.broadcast(names))  # four dimensions
    return fidelity.normalised(rows.select("i", "dimension", F.floor(noise(F.col("i"), F.col("dimension")) * 2.9999).cast("long").alias("score")))


#: Our own outputs for the graded cases, appended to drafts as the detectors' suffixes are.
RUNS = (
    "\n\nI found your past emails and messages. See https://example.org for the sync fix, the retry of webhooks and the faster cache.",
    "\n\n## Sources\n\nI reviewed your notes. On-call at the weekend — late — was hard. lower case. again so.",
    "\n\n> keep this — as is\n\nYou could suggest it, if you like, before you post; your draft reads like you.\n\n## One\n\n1. first",
    "",
)


#: What stands before some of them.
LEADS = ("", "\r\n\t \u00a0", "", "## `")


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, eval_id, text and original: each draft, with a lead and a suffix of ours, as the output of one of four cases."""
    doc = F.col("doc_id")
    of = lambda texts, by: F.element_at(F.array(*map(F.lit, texts)), (F.pmod(F.floor(doc / by), F.lit(len(texts))) + 1).cast("int"))
    rows = prose.drafts(spark, sf_dir, original=True)
    return rows.select(doc.alias("run_id"), F.pmod(F.floor(doc / 2), F.lit(4)).cast("int").alias("eval_id"), F.concat(of(LEADS, 8), "text", of(RUNS, 8)).alias("text"), "original")


def _of_sql(texts: tuple, by: int) -> str:
    return f"([{', '.join(map(S.quoted, texts))}])[((d.doc_id // {by}) % {len(texts)}) + 1]"


_OUTPUTS = f"(SELECT d.doc_id AS run_id, ((d.doc_id // 2) % 4)::INT AS eval_id, {_of_sql(LEADS, 8)} || t.text || {_of_sql(RUNS, 8)} AS text, d.text AS original FROM documents d JOIN {prose.DRAFTS} t USING (doc_id))"


def with_clean(rows: DataFrame) -> DataFrame:
    """Whether a scan of the output finds nothing."""
    counted = D.counts(rows.select("run_id", F.lit("").alias("author"), "text"), "run_id", "author").withColumnRenamed("run_id", "doc_id")
    dirty = written(tells.scan(counted).select(F.col("doc_id").alias("run_id")).distinct().withColumn("dirty", F.lit(True)), "dirty")  # each case reads it
    return rows.join(dirty, "run_id", "left").withColumn("clean", F.col("dirty").isNull()).drop("dirty")


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assertions of the three cases that SQL can check too."""
    rows = outputs(spark, sf_dir)
    checked = with_clean(rows.where("eval_id in (0, 2)"))
    return grading.commit_message(checked.where("eval_id = 0")).unionByName(grading.cleaned_draft(rows.where("eval_id = 1"))).unionByName(grading.statement(checked.where("eval_id = 2")))


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.rollup(outputs(spark, sf_dir).select("run_id", "eval_id"), graded(spark, sf_dir))


def _found(x: str, patterns) -> str:
    return "(" + " + ".join(f"regexp_matches({x}, {S.quoted(p)})::INT" for p in patterns) + ")"


def _starts(x: str, letters: str) -> str:
    marked = f"regexp_replace({x}, '([.!?]\\s)([A-Za-z])', '\\1' || chr(1) || '\\2', 'g')"
    return f"(len(regexp_extract_all({marked}, '(?m)^[{letters}]')) + len(regexp_extract_all({marked}, chr(1) || '[{letters}]')))"


def _ratio(x: str) -> str:
    return f"coalesce({_starts(x, 'a-z')}::DOUBLE / nullif({_starts(x, 'A-Za-z')}, 0), 0)"


def _graded_sql() -> str:
    c = {
        0: [("subject_lowercase", r"regexp_matches(regexp_extract(subject, '\p{L}'), '\p{Ll}')"), ("subject_no_period", "NOT ends_with(subject, '.')"), ("body_explains_why", "NULL::BOOLEAN"),
            ("no_process_leak", f"{_found('plain', grading.PROCESS)} = 0"), ("scan_clean", "clean")],
        1: [("vocabulary_removed", _found("plain", [rf"(?i)\b{w}\b" for w in grading.BANNED]) + " = 0"), ("signoff_removed", f"{_found('plain', grading.CHATBOT)} = 0"),
            ("parallelism_removed", f"{_found('plain', grading.NEGATIVE)} = 0"), ("bullets_removed", f"{S.times('text', grading.INLINE_BULLET)} = 0"), ("em_dashes_kept", f"{S.times('text', '—')} >= 2"),
            ("habit_kept", f"({_ratio('plain')} > 0.5 OR {S.times('text', grading.BOLD)} >= 2)"), ("no_process_leak", f"{_found('plain', grading.PROCESS)} = 0"),
            ("items_retained", f"{_found('plain', grading.ITEMS.values())} = {len(grading.ITEMS)}"), ("imports_flagged", "NULL::BOOLEAN")],
        2: [("no_sample_claims", f"{_found('plain', grading.CLAIMS)} = 0"), ("no_made_up_links", f"{S.times('plain', grading.LINK)} = 0"), ("scan_clean", "clean"), ("states_reason", f"{S.times('plain', grading.REASON)} > 0")],
    }
    subject = prose.SUBJECT
    counts = S.counts("outs", "run_id")
    rate = S.rate("count", "words")
    head = f"""outs AS MATERIALIZED (SELECT * FROM {_OUTPUTS}), cn AS MATERIALIZED ({counts}),
      dirty AS (SELECT DISTINCT run_id FROM cn JOIN {S.registry()} ON cn.key = registry.key WHERE count > 0 AND (NOT gated OR (count >= min_count AND {rate} > floor))),
      o AS MATERIALIZED (SELECT *, {S.folded("text")} AS plain, {subject} AS subject, run_id NOT IN (SELECT run_id FROM dirty) AS clean FROM outs),
      graded AS ("""
    body = " UNION ALL ".join(f"SELECT run_id, eval_id, {k} AS site, '{name}' AS assertion, {check} AS passed FROM o WHERE eval_id = {e}" for e, checks in c.items() for k, (name, check) in enumerate(checks))
    return head + body + ")"


_GRADED = _graded_sql()


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation and the next one, side by side."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return rows.select("conv_id", "turn", "text").join(after, ["conv_id", "turn"])


_TURNS = f"SELECT a.conv_id * 1000 + a.turn AS id, {S.blank_tokens('a.text')} AS a, {S.blank_tokens('b.text')} AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"
OUTPUT_TOKENS = f"SELECT run_id AS id, {S.blank_tokens('original')} AS a, {S.blank_tokens('text')} AS b FROM {_OUTPUTS}"


def once_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.once_over(outputs(spark, sf_dir).where("eval_id = 3"))


CONFIGS = ("with", "without")


def contract(spark: SparkSession, sf_dir: str, long_only: bool = False) -> DataFrame:
    """Conversations as cases that declare a document a turn, some of which there aren't; every fourth case declares none."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    name = F.when(F.pmod("conv_id", F.lit(4)) != 2, F.concat(F.lit("doc-"), F.col("conv_id") * 3 + F.col("turn")))
    specs = rows.groupBy(F.col("conv_id").alias("eval_id")).agg(F.collect_list(name).alias("files"))  # a conversation's turns
    there = prose.documents(spark, sf_dir).select(F.concat(F.lit("doc-"), "doc_id").alias("file")).distinct()
    only = rows.where("turn >= 3").select(F.col("conv_id").alias("eval_id")) if long_only else None
    return grading.contract(specs, there, spark.createDataFrame([(c,) for c in CONFIGS], "config string"), only)


def _contract_sql(only: str = "") -> str:
    return f"""SELECT eval_id, config, file, file IS NULL AS declares_none, file IS NOT NULL AND file NOT IN (SELECT 'doc-' || doc_id FROM documents) AS missing
      FROM (SELECT conv_id AS eval_id, 'doc-' || (conv_id * 3 + turn) AS file FROM conversations WHERE conv_id % 4 <> 2 UNION ALL SELECT DISTINCT conv_id, NULL FROM conversations WHERE conv_id % 4 = 2),
        (VALUES {', '.join(f'({S.quoted(c)})' for c in CONFIGS)}) c(config){only}"""


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model mirrors its share of all exemplars, numbered by id."""
    ids = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("id"))
    models = spark.createDataFrame([(k, m) for k, m in enumerate(MODELS)], "pos long, generator string")
    return dataset.assignments(models, dataset.numbered(ids, ["id"]), -(-ids.count() // len(MODELS)))


def _done(rows: DataFrame) -> DataFrame:
    return rows.where(noise(F.col("generator"), F.col("mirrors")) < 0.5).select("generator", "mirrors")


_ASSIGNED = f"""WITH ex AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM labels WHERE quality = 1), pn AS (SELECT count(*) AS n, (count(*) + {len(MODELS) - 1}) // {len(MODELS)} AS per FROM ex),
  asg AS (SELECT generator, i, id AS mirrors, i % 2 AS brief FROM (VALUES {", ".join(f"({k}, '{m}')" for k, m in enumerate(MODELS))}) m(mi, generator), (SELECT unnest(range(per)) AS i, n, per FROM pn) r JOIN ex ON (mi * per + i) % n = pos)"""


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _done(assigned(spark, sf_dir))
    return rows.groupBy(F.split_part("generator", F.lit("/"), F.lit(1)).alias("family")).agg(F.count("*").alias("n"), F.countDistinct("generator").alias("models"))


#: Plain descent at the published rate, for so many rounds that it has come to rest (the published loop stops after 4,000, a few hundredths before).
EPOCHS, RATE = 24_000, 0.25


def fits_sql(group: str) -> str:
    """CTEs ba (id, label, own, x: answers and 1) and fi (held, w), by plain descent on all rows but those of each group; `group` is null for one fit."""
    x = "[" + ", ".join(taste.KEYS) + ", 1.0::DOUBLE]"
    n, z = len(taste.KEYS) + 1, f"greatest(-{taste.CLAMP}::DOUBLE, least({taste.CLAMP}::DOUBLE, list_dot_product(w, x[i])))"
    return f"""ba AS MATERIALIZED (SELECT id, label, {group} AS own, {x}::DOUBLE[] AS x FROM {answers_sql()}),
      tr AS (SELECT held, list(x ORDER BY id) AS x, list(label ORDER BY id) AS y, sum(label) AS n1, sum(1 - label) AS n0
        FROM (SELECT DISTINCT own AS held FROM ba {"" if group.startswith("NULL") else "WHERE own IS NOT NULL"}) JOIN ba ON {"true" if group.startswith("NULL") else "own IS DISTINCT FROM held"} GROUP BY held),
      dt AS MATERIALIZED (SELECT held, x, list_transform(range(1, {n + 1}), lambda j: list_transform(x, lambda r: r[j])) AS xt, y, list_transform(y, lambda v: CASE WHEN v = 1 THEN 0.5::DOUBLE / n1 ELSE 0.5::DOUBLE / n0 END) AS c FROM tr),
      it AS (SELECT held, 0 AS k, list_transform(range({n}), lambda j: 0::DOUBLE) AS w FROM dt
        UNION ALL SELECT held, k + 1, list_transform(range(1, {n + 1}), lambda j: w[j] - {RATE}::DOUBLE * (list_dot_product(e, xt[j]) + CASE WHEN j < {n} THEN {logistic.L2}::DOUBLE * w[j] ELSE 0 END))
          FROM (SELECT it.held, k, w, xt, list_transform(range(1, len(x) + 1), lambda i: (1 / (1 + exp(-{z})) - y[i]) * c[i]) AS e FROM it JOIN dt ON it.held IS NOT DISTINCT FROM dt.held WHERE k < {EPOCHS})),
      fi AS MATERIALIZED (SELECT held, w FROM it WHERE k = {EPOCHS})"""


def _auc_sql(by: str, source: str) -> str:
    """auc of each group of (by, p, label); null with one label only."""
    return f"""SELECT {by}, CASE WHEN np * nn > 0 THEN ((w2 * 2000 + 2 * np * nn) // (4 * np * nn))::DOUBLE / 1000 END AS auc FROM (SELECT {by}, sum(label)::BIGINT AS np, sum(1 - label)::BIGINT AS nn,
      (SELECT coalesce(sum(CASE WHEN a.p > b.p THEN 2 WHEN a.p = b.p THEN 1 ELSE 0 END), 0)::BIGINT FROM {source} a JOIN {source} b ON a.{by} = b.{by} AND a.label = 1 AND b.label = 0 WHERE a.{by} = s.{by}) AS w2 FROM {source} s GROUP BY {by})"""


_P = f"round(1 / (1 + exp(-greatest(-{taste.CLAMP}::DOUBLE, least({taste.CLAMP}::DOUBLE, list_dot_product(w, x))))), 6)"
_FOLD = f"('0x' || substr(md5(concat_ws('/', id, '{taste.SEED}')), 1, 6))::BIGINT % {taste.FOLDS}"
_FIT = f"""WITH RECURSIVE {fits_sql("NULL::VARCHAR")} SELECT unnest([{', '.join(map(S.quoted, (*taste.KEYS, 'bias')))}]) AS key, round(unnest(w), 3) AS weight FROM fi"""
_CV = f"""WITH RECURSIVE {fits_sql(_FOLD)}, hd AS MATERIALIZED (SELECT own AS fold, label, {_P} AS p, 1 AS every FROM ba JOIN fi ON own = held),
  ht AS (SELECT fold, avg(((p > 0.5)::INT = label)::INT::DOUBLE) AS hit, count(*) AS n FROM hd GROUP BY fold), au AS ({_auc_sql("fold", "hd")}), po AS ({_auc_sql("every", "hd")})
  SELECT sum(n)::BIGINT AS n, round(avg(hit), 3) AS accuracy, round(stddev_pop(hit), 3) AS sd_accuracy, (SELECT round(avg(auc), 3) FROM au) AS mean_auc, (SELECT round(stddev_pop(auc), 3) FROM au) AS sd_auc, (SELECT auc FROM po) AS pooled_auc FROM ht"""
_LOGO = f"""WITH RECURSIVE {fits_sql("generator")}, sc AS MATERIALIZED (SELECT held, label, own IS NOT DISTINCT FROM held AS unseen, {_P} AS p FROM ba, fi),
  yt AS (SELECT held, i, count(*) FILTER (label = 1 AND p >= i / {taste.GRID}) / (count(*) FILTER (label = 1))::DOUBLE + count(*) FILTER (label = 0 AND p < i / {taste.GRID}) / (count(*) FILTER (label = 0))::DOUBLE - 1 AS j FROM sc, range(1, {taste.GRID}) r(i) WHERE NOT unseen GROUP BY held, i),
  yd AS (SELECT held, i / {taste.GRID} AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY held ORDER BY j DESC, i) AS r FROM yt) WHERE r = 1),
  un AS (SELECT held, count(*) AS n, round(avg((p < threshold)::INT::DOUBLE), 3) AS rejected, round(any_value(threshold), 3) AS threshold, round(sum(p::DECIMAL(22, 6))::DOUBLE / count(*), 3) AS mean_score FROM sc JOIN yd USING (held) WHERE unseen GROUP BY held),
  ex AS (SELECT held, round(sum(p::DECIMAL(22, 6))::DOUBLE / count(*), 3) AS exemplar_mean FROM sc WHERE label = 1 GROUP BY held),
  bo AS MATERIALIZED (SELECT held, p, label FROM sc WHERE label = 1 UNION ALL SELECT held, p, 0 FROM sc WHERE unseen), au AS ({_auc_sql("held", "bo")})
  SELECT held AS generator, n, rejected, threshold, mean_score, exemplar_mean, auc AS auc_vs_exemplars FROM un JOIN ex USING (held) JOIN au USING (held)"""
_LADDERS = f"SELECT item_id AS source_id, a.x::INT AS low, b.x::INT AS high FROM benchmark, range({RUNGS}) a(x), range({RUNGS}) b(x) WHERE item_id % 9 <> 4 AND a.x < b.x"

QUERIES = {
    "taste_dimensions": dimension_means,
    "class_weights": lambda s, d: taste.class_weights(answers(s, d)),
    "axis_scores": lambda s, d: scores(s, d).drop("generator"),
    "auc_rank": lambda s, d: taste.auc(scores(s, d), "axis"),
    "youden": lambda s, d: taste.youden(scores(s, d), "axis"),
    "weight_report": weights,
    "model_scores": model_scores,
    "rewrite_compare": lambda s, d: taste.compare_axes(answers(s, d, "b"), answers(s, d, "a", 0.05)),
    "rewrite_losses": lambda s, d: taste.lost(answers(s, d, "b"), answers(s, d, "a", 0.05)),
    "generator_auc": generator_auc,
    "generalize_summary": lambda s, d: taste.generalize_summary(generator_auc(s, d)),
    "logistic_fit": lambda s, d: s.createDataFrame([(k, round(w, 3)) for k, w in (lambda f: [*f[0], ("bias", f[1])])(taste.fit(answers(s, d)))], "key string, weight double"),
    "cv_metrics": lambda s, d: taste.cross_validated(answers(s, d)),
    "leave_one_generator_out": lambda s, d: taste.leave_one_generator_out(answers(s, d)),
    "ladder_pairs": lambda s, d: pairwise.level_pairs(pairwise.usable(rungs(s, d)), "source_id"),
    "pair_debias": debiased,
    "rank_accuracy": lambda s, d: pairwise.accuracy(debiased(s, d), "formulation"),
    "spearman": rhos,
    "verdicts": verdicts,
    "null_control": lambda s, d: pairwise.null_control(comparisons(s, d), "source_id", "formulation", "slot_a"),
    "bradley_terry": lambda s, d: pairwise.bradley_terry(debiased(s, d), "source_id", "formulation"),
    "candidate_ranking": lambda s, d: pairwise.ranked(debiased(s, d).where("formulation = 'craft'").drop("formulation"), "source_id"),
    "fidelity_trials": lambda s, d: trials(s, d).select("label", "i", "real_is_a", "p_real"),
    "fidelity_error": lambda s, d: fidelity.fidelity(trials(s, d), "label"),
    "fidelity_control": lambda s, d: fidelity.control(trials(s, d), "label"),
    "heldout_rotation": lambda s, d: fidelity.rotated(s.createDataFrame([(k, f"held{k}") for k in range(3)], "pos long, held_id string"), trials(s, d).select("label", "i")),
    "voice_dimensions": voice,
    "assertions": graded,
    "assertion_rollup": rollup,
    "assertions_once_over": once_over,
    "token_similarity": lambda s, d: outputs(s, d).select("run_id", rounded(token_similarity(F.col("original"), F.col("text")), 6).alias("similarity")),
    "turn_similarity": lambda s, d: turns(s, d).select("conv_id", "turn", rounded(token_similarity("text", "next"), 6).alias("similarity")),
    "lowercase_ratio": lambda s, d: outputs(s, d).select("run_id", rounded(grading.lowercase_ratio(T.folded(F.col("text"))), 6).alias("ratio")),
    "file_contract": contract,
    "file_contract_only": lambda s, d: contract(s, d, long_only=True),
    "negatives_assignment": assigned,
    "resume_pending": lambda s, d: dataset.pending(assigned(s, d), _done(assigned(s, d)), ["generator", "mirrors"]),
    "negative_families": families,
}

_DIMENSIONS = "(VALUES " + ", ".join(f"('{k}', {s}::INT, {b}::INT)" for k, s, b in taste.DIMENSIONS) + ") d(key, sign, battery)"
_NEEDED_DONE = f"{noise_sql('generator', 'mirrors')} < 0.5"
ORACLES = {
    "taste_dimensions": f"""WITH an AS MATERIALIZED (SELECT * FROM {answers_sql()}), lg AS ({" UNION ALL ".join(f"SELECT '{k}' AS key, label, {k} AS value FROM an" for k in taste.KEYS)}),
      mn AS (SELECT key, {", ".join(f"round((sum(value::DECIMAL(22, 4)) FILTER (label = {y}))::DOUBLE / count(*) FILTER (label = {y}), 6) AS {name}" for y, name in ((1, "exemplars"), (0, "others")))} FROM lg GROUP BY key)
      SELECT key, sign, battery, exemplars, others, sign(exemplars - others) = sign AS as_expected FROM {_DIMENSIONS} JOIN mn USING (key)""",
    "class_weights": "SELECT quality AS label, count(*) AS n, (sum(count(*)) OVER ())::DOUBLE / (2 * count(*)) AS weight FROM labels GROUP BY quality",
    "axis_scores": _scores_sql("id, label", answers_sql()),
    "auc_rank": f"WITH s AS MATERIALIZED ({_scores_sql('id, label', answers_sql())}) SELECT a.axis, {_AUC} AS auc, count(DISTINCT a.id) AS n_pos, count(DISTINCT b.id) AS n_neg FROM s a JOIN s b ON a.axis = b.axis AND a.label = 1 AND b.label = 0 GROUP BY a.axis",
    "youden": f"""WITH s AS MATERIALIZED ({_scores_sql('id, label', answers_sql())}),
      t AS (SELECT axis, i, count(*) FILTER (label = 1 AND p >= i / {taste.GRID}) / (count(*) FILTER (label = 1))::DOUBLE + count(*) FILTER (label = 0 AND p < i / {taste.GRID}) / (count(*) FILTER (label = 0))::DOUBLE - 1 AS j
        FROM s, range(1, {taste.GRID}) r(i) GROUP BY axis, i)
      SELECT axis, i / {taste.GRID} AS threshold, round(j, 6) AS j FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY j DESC, i) AS r FROM t) WHERE r = 1""",
    "weight_report": f"""WITH ws AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{k}', {w!r}::DOUBLE)" for a, (ws, _) in taste.AXES.items() for k, w in ws)}) w(axis, key, weight) UNION ALL SELECT 'fitted', key, weight FROM ({_FIT}) WHERE key <> 'bias')
      SELECT axis, key, weight, sign, weight <> 0 AND sign(weight) <> sign AS disagrees, row_number() OVER (PARTITION BY axis ORDER BY abs(weight) DESC, key) AS place FROM ws JOIN {_DIMENSIONS} USING (key)""",
    "model_scores": f"""WITH RECURSIVE {fits_sql("NULL::VARCHAR")}, rw AS (SELECT list_transform(w, lambda v: round(v, 3)) AS w FROM fi) SELECT id, label, 'score' AS axis, {_P} AS p FROM ba, rw""",
    "rewrite_compare": f"""WITH b AS MATERIALIZED ({_scores_sql('id', answers_sql('b'))}), a AS MATERIALIZED ({_scores_sql('id', answers_sql('a', 0.05))})
      SELECT id, axis, b.p AS before, a.p AS after, round(a.p - b.p, 6) AS delta, a.p < b.p - {taste.AXIS_DROP}::DOUBLE AS worse FROM b JOIN a USING (id, axis)""",
    "rewrite_losses": f"""WITH l AS ({" UNION ALL ".join(f"SELECT id, '{k}' AS key, b.{k} AS before, a.{k} AS after FROM b JOIN a USING (id)" for k, s, _ in taste.DIMENSIONS if s > 0)})
      SELECT * FROM (SELECT id, key, before, after, round(before - after, 6) AS drop, row_number() OVER (PARTITION BY id ORDER BY round(before - after, 6) DESC, key DESC) AS place FROM l WHERE round(before - after, 6) > {taste.DIMENSION_DROP}) WHERE place <= {taste.TOP}""".replace("WITH l AS", f"WITH b AS MATERIALIZED (SELECT * FROM {answers_sql('b')}), a AS MATERIALIZED (SELECT * FROM {answers_sql('a', 0.05)}), l AS"),
    "generator_auc": _GENERATOR_AUC,
    "generalize_summary": f"SELECT count(*) AS n, list(auc ORDER BY auc)[count(*) // 2 + 1] AS median_auc, min(auc) AS worst_auc FROM ({_GENERATOR_AUC})",
    "logistic_fit": _FIT,
    "cv_metrics": _CV,
    "leave_one_generator_out": _LOGO,
    "ladder_pairs": _LADDERS,
    "pair_debias": f"WITH {_PAIRS} SELECT source_id, formulation, low::INT AS low, high::INT AS high, p, bias FROM deb",
    "rank_accuracy": f"WITH {_PAIRS}, {_ACCURACY} SELECT * FROM acc",
    "spearman": f"WITH {_PAIRS}, {_WINS} SELECT * FROM rho",
    "verdicts": f"WITH {_PAIRS}, {_ACCURACY}, {_WINS} {_VERDICT}",
    "null_control": f"WITH {_PAIRS} SELECT source_id, formulation, slot_a::INT AS slot_a, round(max(p_a)::DECIMAL(20, 6), 3)::DOUBLE AS worst_single_order, round(((max(p_a) FILTER (turn = 0) + 1 - max(p_a) FILTER (turn = 1)) / 2)::DECIMAL(20, 6), 3)::DOUBLE AS debiased_sample FROM cmp WHERE slot_a = slot_b GROUP BY source_id, formulation, slot_a",
    "fidelity_trials": f"WITH {_TRIALS} SELECT label, i, real_is_a, p_real FROM tr",
    "fidelity_error": f"""WITH {_TRIALS}, m AS (SELECT label, count(*) AS n, sum(p_real::DECIMAL(22, 4))::DOUBLE / count(*) AS m, sum((p_real::DECIMAL(15, 4) * p_real::DECIMAL(15, 4))::DECIMAL(30, 8))::DOUBLE / count(*) AS q FROM tr GROUP BY label)
      SELECT label, n, round(m, 3) AS mean_p, round(sqrt(greatest(0.0::DOUBLE, q - m * m)), 3) AS stdev, round(abs(m - 0.5::DOUBLE) * 2, 3) AS fidelity_error,
        CASE WHEN round(abs(m - 0.5::DOUBLE) * 2, 3) < 0.25 THEN 'indistinguishable' WHEN m < 0.5 THEN 'OVERSHOOT' ELSE 'UNDERSHOOT' END AS direction FROM m""",
    "fidelity_control": f"WITH {_TRIALS} SELECT *, mean_p BETWEEN 0.3 AND 0.7 AS ok FROM (SELECT label, count(DISTINCT held_id) AS held, round(sum(p_real::DECIMAL(22, 4))::DOUBLE / count(*), 3) AS mean_p FROM tr GROUP BY label) WHERE held >= 2",
    "heldout_rotation": "SELECT conv_id % 23 AS label, conv_id * 1000 + turn AS i, 'held' || ((conv_id * 1000 + turn) % 3) AS held_id FROM conversations",
    "voice_dimensions": f"SELECT i, dimension, score, round(score::DOUBLE / 2, 3) AS normalized FROM (SELECT i, dimension, floor({noise_sql('i', 'dimension')} * 2.9999::DOUBLE)::BIGINT AS score FROM (SELECT conv_id * 1000 + turn AS i FROM conversations), (VALUES {', '.join(f'({S.quoted(k)})' for k in fidelity.LEVELS)}) t(dimension))",
    "assertions": f"WITH {_GRADED} SELECT run_id, eval_id, site::INT AS site, assertion, passed FROM graded",
    "assertion_rollup": f"""WITH {_GRADED}, r AS (SELECT run_id, sum(coalesce(passed, false)::INT)::BIGINT AS passed, sum((passed IS NOT NULL AND NOT passed)::INT)::BIGINT AS failed, count(passed) AS total, (count(*) - count(passed)) AS manual_pending FROM graded GROUP BY run_id)
      SELECT outs.run_id, eval_id, coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed, coalesce(total, 0) AS total, CASE WHEN total IS NOT NULL THEN round(coalesce(passed::DOUBLE / nullif(total, 0), 0), 4) END AS pass_rate, coalesce(manual_pending, 0) AS manual_pending, CASE WHEN manual_pending IS NULL THEN 'MISSING' ELSE 'graded' END AS status FROM outs LEFT JOIN r ON outs.run_id = r.run_id""",
    "token_similarity": f"WITH RECURSIVE {S.similarity(OUTPUT_TOKENS)} SELECT id AS run_id, round(similarity, 6) AS similarity FROM sim",
    "turn_similarity": f"WITH RECURSIVE {S.similarity(_TURNS)} SELECT id // 1000 AS conv_id, id % 1000 AS turn, round(similarity, 6) AS similarity FROM sim",
    "lowercase_ratio": f"SELECT run_id, round({_ratio('plain')}, 6) AS ratio FROM (SELECT run_id, {S.folded('text')} AS plain FROM {_OUTPUTS})",
    "file_contract": _contract_sql(),
    "file_contract_only": _contract_sql(" WHERE eval_id IN (SELECT conv_id FROM conversations WHERE turn >= 3)"),
    "negatives_assignment": f"{_ASSIGNED} SELECT * FROM asg",
    "resume_pending": f"{_ASSIGNED} SELECT * FROM asg WHERE NOT ({_NEEDED_DONE})",
    "negative_families": f"{_ASSIGNED} SELECT split_part(generator, '/', 1) AS family, count(*) AS n, count(DISTINCT generator) AS models FROM asg WHERE {_NEEDED_DONE} GROUP BY ALL",
}
