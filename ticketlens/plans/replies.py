"""Reply drafting grounded in similar past tickets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_blanks, words
from ..operators.models import ColumnFunction


@dataclass(frozen=True)
class Contact:
    """Where a customer is sent when there is no safe answer."""

    email: str
    phone: str

    # Fixed value: the message the address and number go in.
    def message(self) -> str:
        return f"Please contact our support team for assistance:\nEmail: {self.email}\nPhone: {self.phone}"


# What a model is sent before the issue and its neighbours: the inputs it finds below, what it must give back,
# and what to do where there is nothing to go by. Replace them by your own.
AGENT_INSTRUCTION = """INPUT: "Issue" is one customer message. "Earlier tickets" lists resolved tickets, numbered by rank (1 is the most similar), each with subject, body and answer.
OUTPUT: a draft that an agent will check. End it with a line "Based on: " and the ranks you used.
RULES: write in the language of the issue. State only what an answer in the list states. Where answers contradict each other, give the steps that can be undone and name the contradiction. If the list is empty or no answer fits, output "No evidence: " and the question the agent should ask next."""


def help_instruction(contact: Contact) -> str:
    return f"""INPUT: "Issue" is a question typed into a public help page. "Earlier tickets" lists resolved tickets, numbered by rank (1 is the most similar).
OUTPUT: either numbered steps the reader can do alone, with a last line "Based on: " and the ranks used, or exactly this message:
{contact.message()}
RULES: write in the language of the issue. A question of general knowledge about using the shop may be answered without the list. Otherwise give the message if the list is empty, if no answer in it fits, if its answers contradict each other, or if the question concerns one particular account, order or payment."""


# Words by which a question is about one account, order or payment, and so is not for a general answer.
PERSONAL_WORDS = ("my account", "my order", "my payment", "my invoice", "order number", "tracking number")


def neighbours_by_query(found: DataFrame) -> DataFrame:
    """One row per query: its neighbours by rank. A group has at most k rows."""
    filled = found.na.fill("", ["subject", "body", "answer"])
    neighbour = F.struct("rank", "distance", "subject", "body", "answer")
    return filled.groupBy("query_id").agg(F.array_sort(F.collect_list(neighbour)).alias("neighbours"))


def _prior(neighbours: Column) -> Column:
    """The neighbours as prompt text; '' when there are none."""

    def one(n: Column) -> Column:
        return F.concat(
            n["rank"].cast("string"), F.lit(". subject: "), n["subject"], F.lit("\n  body: "), n["body"], F.lit("\n  answer: "), n["answer"]
        )

    return F.coalesce(F.array_join(F.transform(neighbours, one), "\n"), F.lit(""))


def reply_prompts(issues: DataFrame, found: DataFrame, id_col: str, text_col: str, instruction: str = AGENT_INSTRUCTION) -> DataFrame:
    """(query_id, issue, neighbours, prompt) for every issue, also those without a neighbour."""
    asked = issues.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("issue"))
    prompt = F.concat(
        F.lit(instruction + "\n\nIssue:\n"), F.coalesce("issue", F.lit("")), F.lit("\n\nEarlier tickets:\n"), _prior(F.col("neighbours"))
    )
    return asked.join(neighbours_by_query(found), "query_id", "left").withColumn("prompt", prompt)


def nearest_answer(found: DataFrame, max_distance: float) -> DataFrame:
    """The built-in replies, (query_id, reply): the nearest ticket's answer, if it is near enough."""
    near = found.where((F.col("rank") == 1) & (F.col("distance") <= max_distance))
    return near.select("query_id", F.col("answer").alias("reply"))


def agreed_answers(found: DataFrame, apart: float = 0.5) -> DataFrame:
    """(query_id, reply, rank, n_answers, agreement) of every query with an answer: the one that stands in the middle of all its neighbours' answers.

    Two answers are as far apart as the share of their distinct words that only one has. The reply is the answer with the least sum of
    distances to the others, the better rank of equal ones; ``agreement`` is the share of the other answers at most ``apart`` from it, 1.0 where
    there is no other. Blank answers do not count. At most k answers of a query meet, inside one row.
    """
    tokens = F.array_sort(F.array_distinct(F.filter(words(F.col("answer")), lambda w: w != "")))
    filled = found.where(F.length(strip_blanks(F.col("answer"))) > 0).select("query_id", F.struct("rank", "answer", tokens.alias("words")).alias("a"))
    grouped = filled.groupBy("query_id").agg(F.array_sort(F.collect_list("a")).alias("all"))

    def distance(a: Column, b: Column) -> Column:
        either = F.size(F.array_union(a["words"], b["words"]))
        return F.coalesce(1 - F.try_divide(F.size(F.array_intersect(a["words"], b["words"])), either), F.lit(0.0))

    def placed(a: Column) -> Column:
        gaps = F.transform("all", lambda b: distance(a, b))
        near = F.size(F.filter(gaps, lambda g: g <= apart)) - 1
        total = F.round(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g), 9)
        return F.struct(total.alias("total"), a["rank"].alias("rank"), a["answer"].alias("answer"), near.alias("near"))

    best = grouped.select("query_id", F.size("all").cast("long").alias("n_answers"), F.array_min(F.transform("all", placed)).alias("best"))
    share = F.coalesce(F.try_divide(F.col("best.near"), F.col("n_answers") - 1), F.lit(1.0))
    return best.select("query_id", F.col("best.answer").alias("reply"), F.col("best.rank").alias("rank"), "n_answers", share.alias("agreement"))


def agreed_or_asked(issues: DataFrame, found: DataFrame, id_col: str, contact: Contact, least_agreement: float = 0.5, apart: float = 0.5) -> DataFrame:
    """(query_id, reply, agreement, asked): the agreed answer, or the contact message where the neighbours' answers contradict each other or there is none."""
    agreed = agreed_answers(found, apart)
    joined = issues.select(F.col(id_col).alias("query_id")).join(agreed, "query_id", "left")
    sure = F.coalesce(F.col("agreement") >= least_agreement, F.lit(False))
    return joined.select("query_id", F.when(sure, F.col("reply")).otherwise(F.lit(contact.message())).alias("reply"), F.coalesce("agreement", F.lit(0.0)).alias("agreement"), (~sure).alias("asked"))


def draft(prompts: DataFrame, generator: ColumnFunction) -> DataFrame:
    """Prompts plus a trimmed ``reply``, '' when the model gave none."""
    return prompts.withColumn("reply", F.coalesce(strip_blanks(generator(F.col("prompt"))), F.lit("")))


def answer_or_route(
    issues: DataFrame,
    found: DataFrame,
    id_col: str,
    text_col: str,
    contact: Contact,
    max_distance: float = 1.0,
    generator: ColumnFunction | None = None,
    personal: Sequence[str] = PERSONAL_WORDS,
) -> DataFrame:
    """(query_id, reply, routed): an answer, or the contact message when there is none.

    Without a generator, the nearest ticket's answer is given if it is near enough and the
    question has none of the ``personal`` phrases; a generator is told to judge that itself.
    """
    if generator:
        prompts = reply_prompts(issues, found, id_col, text_col, help_instruction(contact))
        drafted = prompts.select("query_id", generator(F.col("prompt")).alias("reply"))
    else:
        text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
        about_one = reduce(Column.__or__, [text.contains(phrase) for phrase in personal], F.lit(False))
        asked = issues.select(F.col(id_col).alias("query_id"), about_one.alias("_about_one"))
        drafted = asked.join(nearest_answer(found, max_distance), "query_id", "left")
        drafted = drafted.withColumn("reply", F.when(~F.col("_about_one"), F.col("reply")))
    replied = drafted.select("query_id", F.nullif(strip_blanks(F.col("reply")), F.lit("")).alias("_reply"))
    return replied.select(
        "query_id",
        F.coalesce("_reply", F.lit(contact.message())).alias("reply"),
        F.col("_reply").isNull().alias("routed"),
    )
