"""Inputs for the graded cases, made from authors' documents: a history of commits, notes of the past and two drafts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkmill.functions import text as T

#: Commits of a history.
LATEST = 8
#: What a draft of three items holds: habits to lose in the one, habits to keep in the other.
LOUD = (
    "Our robust new till is live!\n\n- **Labels**: no more duplicates\n- **Cards**: a declined one has one retry\n- **Prices**: the list opens faster\n\n"
    "It is not only quicker, but calmer. Let me know if questions come up.\n"
)
PLAIN = "labels print once now — the queue had kept a duplicate. a declined card gets a retry.\n\nprices open faster — by how much on old tablets, nobody has timed.\n"


def commits(docs: DataFrame) -> DataFrame:
    """author, place, subject and body of each author's LATEST last documents, the oldest of them first. docs: (doc_id, author, text)."""
    newest = F.row_number().over(Window.partitionBy("author").orderBy(F.desc("doc_id")))
    rows = docs.select("doc_id", "author", "text").withColumn("r", newest).where(F.col("r") <= LATEST)
    place = F.row_number().over(Window.partitionBy("author").orderBy(F.desc("r"))) - 1
    return rows.select("author", place.alias("place"), T.subject_line(F.lower("text")).alias("subject"), T.stripped(F.col("text")).alias("body"))


def files(docs: DataFrame) -> DataFrame:
    """author, name and text of history.md, draft.md and notes.md of each author."""
    each = commits(docs).groupBy("author").agg(F.sort_array(F.collect_list(F.struct("place", "subject"))).alias("c"))  # LATEST at most
    subjects = F.col("c.subject")
    last = F.element_at(subjects, -1)
    made = {
        "history.md": F.concat(F.lit("# "), F.coalesce("author", F.lit("")), F.lit("\n\n"), F.array_join(subjects, "\n"), F.lit("\n")),
        "draft.md": F.concat(last, F.lit("\n\n" + LOUD)), "notes.md": F.concat(last, F.lit("\n\n" + PLAIN)),
    }
    return each.select("author", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), t.alias("text")) for n, t in made.items()))).alias("f")).select("author", "f.*")


def write(docs: DataFrame, author: str, path: str) -> None:
    """One author's files below a folder of this machine, with the commit messages in one, for a judge or a person."""
    own = docs.where(F.col("author") == author)
    os.makedirs(path, exist_ok=True)
    history = "\n\n".join(f"{r['subject']}\n\n{r['body']}" for r in commits(own).orderBy("place").collect())  # LATEST at most
    for name, text in (*((r["name"], r["text"]) for r in files(own).collect()), ("repo.txt", history + "\n")):
        with open(os.path.join(path, name), "w", encoding="utf-8") as out:
            out.write(text)
