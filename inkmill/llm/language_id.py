"""Language identification by compression with per-language dictionaries.

A sample of labelled texts of each language is a raw-content zstandard dictionary. A text
is compressed with every dictionary, and the language whose dictionary makes it smallest
wins; ties go to the language with the most labelled rows. The score is a logistic function
of the margin between the two smallest, in bits saved a byte, and a narrow margin sets
``rejected``, though the nearest language is still named.

Texts longer than a window are compressed window by window, each with the fresh
dictionary, so that what a text says of itself doesn't drown the dictionary; the sizes
add up over the whole text. Null texts and texts without a letter are ``und`` with score
0. Null languages aren't learned from; with none to learn from, every text is ``und``.
Repeated rows get equal answers, also with one id; an empty table gives no rows. Very long
texts are one task's work each. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm.store import documents

#: Bounds of the sample: whole texts a language, and bytes of these together. A text that doesn't fit is passed over, not cut.
SAMPLE_TEXTS, SAMPLE_BYTES = 48, 256 << 10
LEVEL = 6
WINDOW_BYTES = 8 << 10
#: Below this margin (bytes saved over bytes compressed) an answer is rejected.
MARGIN = 0.01


def fold(column: str = "doc_id", folds: int = 5) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def learn(docs: DataFrame, texts: int = SAMPLE_TEXTS, size: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """The dictionary of each language, from the labelled rows of docs. Which texts are taken depends on a hash of the id, and on their sizes.

    One pass counts the languages, of which there are few; a second takes the texts under a hash bound that lets
    through about twice as many as are wanted, and never more than three times.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.octet_length("text") <= size)).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    if not counts:
        return {}
    near = F.lit(False)
    for name, n in counts.items():
        near = F.when(F.col("lang") == name, F.col("h") < F.lit(min(1 << 40, 2 * texts * (1 << 40) // n))).otherwise(near)
    rows = labelled.where(near).select("lang", "doc_id", "h", "text").orderBy("h", "doc_id", "text").limit(3 * texts * len(counts)).collect()
    return {name: _joined([r["text"].encode() for r in rows if r["lang"] == name], texts, size) for name in counts}


def _joined(own: list[bytes], texts: int, size: int) -> bytes:
    """The first so many of these texts that fit into size bytes together, a line end between them."""
    out: list[bytes] = []
    for text in own:
        if len(out) < texts and sum(map(len, out)) + len(text) <= size:
            out.append(text)
    return b"\n".join(out)


_OUT = "doc_id long, lang_pred string, score double, margin double, rejected boolean"


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin and rejected of each row of docs (doc_id, text)."""
    names = list(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        made = [zstd.ZstdCompressionDict(dictionaries[n], dict_type=zstd.DICT_TYPE_RAWCONTENT) for n in names]
        for d in made:
            d.precompute_compress(level=LEVEL)
        options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        tools = [zstd.ZstdCompressor(dict_data=d, level=LEVEL, **options) for d in made]
        for batch in batches:
            pred, score, margins, no = [], [], [], []
            for value in batch.column(1):
                text = value.as_py()
                if not names or not text or not any(map(str.isalpha, text)):
                    pred.append("und"), score.append(0.0), margins.append(0.0), no.append(True)
                    continue
                raw = text.encode()
                sizes = [0] * len(tools)
                for at in range(0, len(raw), WINDOW_BYTES):
                    window = raw[at : at + WINDOW_BYTES]
                    for k, tool in enumerate(tools):
                        sizes[k] += len(tool.compress(window))
                order = sorted(range(len(sizes)), key=sizes.__getitem__)
                gap = (sizes[order[1]] - sizes[order[0]]) / len(raw) if len(sizes) > 1 else 1.0
                pred.append(names[order[0]])
                margins.append(gap)
                score.append(1 / (1 + math.exp(-min(60.0, gap * len(raw) * 0.25))))
                no.append(gap < margin)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margins, pa.float64()), pa.array(no, pa.bool_())], names=["doc_id", "lang_pred", "score", "margin", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, _OUT)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each row of documents, learned from the rows outside fold 0 of 5."""
    docs = documents(spark, sf_dir)
    found = identify(docs, learn(docs.where(fold() != 0)))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "margin", "rejected")
