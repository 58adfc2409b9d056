"""What mails repeat, found by data instead of patterns: disclaimers, signatures and quoted history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_blanks
from ..session import settle

#: What stands before a quoted line: any number of > and blanks.
_QUOTE_MARKS = r"^[>\s]+"


@dataclass(frozen=True)
class RepeatRule:
    """``least_mails``: a sender's line in so many of their mails is boilerplate. ``least_letters``: shorter lines say too little to judge by."""

    least_mails: int = 3
    least_letters: int = 8


def line_fingerprint(line: Column) -> Column:
    """Equal for lines that differ in case, blanks and quotation marks before them only."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(line, _QUOTE_MARKS, ""), r"\s+", " "))
    return F.sha2(F.btrim(plain), 256)


def thread_lines(mails: DataFrame, id_col: str, thread_col: str, sender_col: str, order_col: str, text_col: str, rule: RepeatRule = RepeatRule()) -> DataFrame:
    """One row per line of every mail: mail, place, line, boilerplate, quoted.

    A line is ``boilerplate`` if the same sender has it in ``least_mails`` mails or more, and ``quoted`` if an earlier mail of the thread has it (by
    ``order_col``, then id). Lines with fewer than ``least_letters`` letters or digits are neither, so that "Yes." stays. A mail without sender or thread is compared
    with none. Ids are unique.

    Only fingerprints are shuffled and counted, combined before the shuffle; a line that very many mails have is one row of the
    counted side, and adaptive execution splits it on the other. Eager: the lines are written with their fingerprints.
    """
    rows = mails.select(
        F.col(id_col).alias("mail"), F.col(thread_col).alias("thread"), F.col(sender_col).alias("sender"), F.struct(F.col(order_col).alias("o"), F.col(id_col).alias("i")).alias("sent"),
        F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("place", "line"),
    )
    letters = F.length(F.regexp_replace("line", r"[^\p{L}\p{N}]+", ""))
    # Written once: the splitting and the fingerprints are most of the work, and are read three times.
    marked = settle(rows.withColumn("mark", F.when(letters >= rule.least_letters, F.unhex(line_fingerprint(F.col("line"))))), "thread-lines")
    judged = marked.where("mark is not null")
    once = judged.where("sender is not null").select("sender", "mark", "mail").distinct()
    often = once.groupBy("sender", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= rule.least_mails).select("sender", "mark", F.lit(True).alias("_often"))
    first = judged.where("thread is not null").groupBy("thread", "mark").agg(F.min("sent").alias("_first"))
    joined = marked.join(often, ["sender", "mark"], "left").join(first, ["thread", "mark"], "left")
    no = F.lit(False)
    return joined.select("mail", F.col("place").cast("long").alias("place"), "line", F.coalesce("_often", no).alias("boilerplate"), F.coalesce(F.col("_first") < F.col("sent"), no).alias("quoted"))


def without_repeats(mails: DataFrame, id_col: str, thread_col: str, sender_col: str, order_col: str, text_col: str, rule: RepeatRule = RepeatRule()) -> DataFrame:
    """(mail, text, n_boilerplate, n_quoted) of every mail: its lines that are neither, in their order, without blanks around. A group is one mail's lines."""
    lines = thread_lines(mails, id_col, thread_col, sender_col, order_col, text_col, rule)
    kept = F.when(~F.col("boilerplate") & ~F.col("quoted"), F.struct("place", "line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["line"]), "\n")
    return lines.groupBy("mail").agg(strip_blanks(text).alias("text"), F.count_if("boilerplate").alias("n_boilerplate"), F.count_if("quoted").alias("n_quoted"))
