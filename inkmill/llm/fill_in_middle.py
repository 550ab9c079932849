"""Fill-in-the-middle transformation by escaped marker injection. SQL functions only.

A text is cut into units: a run of anything but white space with the white space before it,
or the white space at the end. A delimiter character is escaped in the text, together with
the escape itself; both escapes are no white space, so units stay as they were. One
regexp_replace appends the delimiter after every unit, the growth in length is the number
of units, and substring_index takes the first, middle and last of them by rank; taking out
the delimiters and the escapes gives the parts. Where to cut and which form to write comes
from four numbers of a sha256 of the seed and the id, so that it neither depends on the
partition nor on the run. The parts are in one narrow stage: no shuffle, nothing per key.

Null and empty texts have no units and stay plain, as do texts that hold a sentinel, from
which the parts couldn't be told again. A null id is hashed as an empty one. Repeated rows are
transformed alike, rows of one id with differing texts each by its own number of units.
Texts are transformed whole, however long. An empty table gives no rows. Other columns are
kept by `transform` unless they are called like its results, in which case these replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm.store import documents

SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: The delimiter after each unit, the escape, and what follows the escape for itself and for the delimiter.
MARK, ESCAPE, OF_ESCAPE, OF_MARK = "\x01", "\x02", "a", "b"


def escaped(text: Column) -> Column:
    """The text without the delimiter, and with no escape that isn't followed by what it stands for."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + OF_ESCAPE)), F.lit(MARK), F.lit(ESCAPE + OF_MARK))


def unescaped(part: Column) -> Column:
    """What stood in the text for units with their delimiters."""
    out = F.replace(part, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(out, F.lit(ESCAPE + OF_MARK), F.lit(MARK)), F.lit(ESCAPE + OF_ESCAPE), F.lit(ESCAPE))


def _number(group: int) -> Column:
    """The group-th 8 hex digits of the row's hash."""
    return F.conv(F.substring("_hash", 8 * group + 1, 8), 16, 10).cast("long")


def _index(marked: str, rank: Column, back: bool = False) -> Column:
    """The first rank units of a marked text, or what follows all but the last rank - 1 delimiters."""
    rank = F.col(rank) if isinstance(rank, str) else rank
    return F.call_function("substring_index", F.col(marked), F.lit(MARK), (-rank if back else rank).cast("int"))


def transform(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """docs (doc_id, text, ...) with n (units), form (plain, spm, psm), prefix, middle, suffix (null if plain) and output.

    fim_percent of the rows are transformed, spm_percent of these with the suffix first.
    """
    kept = [c for c in docs.columns if c not in ("n", "form", "prefix", "middle", "suffix", "output")]
    prefix, suffix, middle = (F.lit(s) for s in SENTINELS)
    body = F.coalesce(F.col("text"), F.lit(""))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(*kept, F.sha2(key, 256).alias("_hash"), escaped(body).alias("_escaped"))
    rows = rows.select("*", F.regexp_replace("_escaped", F.lit(UNIT), F.lit("$0" + MARK)).alias("_marked"))
    rows = rows.select(*kept, "_hash", "_marked", (F.octet_length("_marked") - F.octet_length("_escaped")).cast("long").alias("n"))
    one, two = F.pmod(_number(0), F.col("n") + 1), F.pmod(_number(1), F.col("n") + 1)
    plain = (F.col("n") == 0) | F.contains(body, prefix) | F.contains(body, suffix) | F.contains(body, middle) | (F.pmod(_number(2), F.lit(100)) >= fim_percent)
    form = F.when(plain, F.lit("plain")).when(F.pmod(_number(3), F.lit(100)) < spm_percent, F.lit("spm")).otherwise(F.lit("psm"))
    rows = rows.select(*kept, "n", "_marked", form.alias("form"), F.least(one, two).alias("_low"), F.greatest(one, two).alias("_high"))
    infill = F.col("form") != "plain"
    rows = rows.select("*", F.when(infill, F.concat(_index("_marked", "_high"), F.lit(MARK))).alias("_head"))
    parts = {
        "prefix": F.when(infill, unescaped(_index("_marked", "_low"))),
        "middle": F.when(infill, unescaped(_index("_head", F.col("_high") - F.col("_low") + 1, back=True))),
        "suffix": F.when(infill, unescaped(_index("_marked", F.col("n") - F.col("_high") + 1, back=True))),
    }
    rows = rows.select(*kept, "n", "form", *(c.alias(name) for name, c in parts.items()))
    output = F.when(F.col("form") == "psm", F.concat(prefix, "prefix", suffix, "suffix", middle, "middle")).when(F.col("form") == "spm", F.concat(suffix, "suffix", prefix, "prefix", middle, "middle"))
    return rows.select("*", F.coalesce(output, body).alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that transform(…) made output from. The sentinels have no character in common between their ends, so the first of each is ours."""
    first, second, last = SENTINELS
    body = F.substring(output, len(first) + 1, 2**31 - 1)

    def rest(text: Column, mark: str) -> tuple[Column, Column]:
        """What stands before the mark and what after it."""
        before = F.substring_index(text, mark, 1)
        return before, F.substring(text, F.length(before) + len(mark) + 1, F.length(text))

    prefix, after = rest(body, second)
    suffix, middle = rest(after, last)
    psm = F.concat(prefix, middle, suffix)
    suffix, after = rest(body, first)
    prefix, middle = rest(after, last)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, lengths and digests of every row of documents."""
    rows = transform(documents(spark, sf_dir).select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE = rf"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS units, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
v AS (SELECT *, len(units) AS n, list_transform(range(4), lambda k: ('0x' || substr(h, 8 * k + 1, 8))::BIGINT) AS hs FROM u),
w AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS lo, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= {FIM_PERCENT} THEN 'plain' WHEN hs[4] % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM v),
x AS (SELECT *, array_to_string(units[1:lo], '') AS p, array_to_string(units[lo + 1:hi], '') AS m, array_to_string(units[hi + 1:], '') AS s FROM w)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM x
"""
