"""Instruction texts for injected models. All are defaults; pass your own.

Each is put together by the same scheme: what the model is given, the form of what it gives back, and the rules of the case.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import LOWEST_PRIORITY, OTHER_TYPE, PRIORITY_RULES, TYPE_RULES


def instruction(given: str, output: str, rules: Sequence[str] = ()) -> str:
    """One instruction; the text follows it. A scorer's output is read as the type of its column, and anything else becomes NULL."""
    lines = [f"INPUT: {given}", f"OUTPUT: {output}", *(f"RULE: {rule}" for rule in rules)]
    return "\n".join(lines) + "\n\n"


SENTIMENT = instruction(
    "the subject and body of one ticket.", "Positive | Neutral | Negative",
    ["judge how the writer feels, not how serious the matter is", "no feeling shown: Neutral"],
)
CHURN = instruction(
    "the subject and body of one ticket.", "a decimal fraction, 0.0 (stays for certain) to 1.0 (leaves for certain)",
    ["weigh what the writer announces: ending a contract, a refund, going elsewhere", "no such sign: 0.0"],
)
ABUSE = instruction("all reviews of one product, a line each.", "true | false", ["true as soon as one line insults, threatens or swears at somebody", "harsh criticism of the product alone: false"])
SATISFACTION = instruction("all reviews of one product, a line each.", "true | false", ["true if more reviewers would buy it again than would not", "as many on both sides: false"])


@dataclass(frozen=True)
class RecordRules:
    """What an extracted record may hold."""

    body_sentences: int = 3
    answer_sentences: int = 5
    subject_words: int = 12
    types: Sequence[str] = (*(label for label, _ in TYPE_RULES), OTHER_TYPE)
    priorities: Sequence[str] = (*(label for label, _ in PRIORITY_RULES), LOWEST_PRIORITY)

    def instruction(self, kind: str) -> str:
        return instruction(
            f"one {kind} between a customer and support, as it was recorded.",
            "JSON with the string fields subject, body, answer, type, priority",
            [
                f"subject: at most {self.subject_words} words",
                f"body: what the customer needs, at most {self.body_sentences} sentences",
                f"answer: what support told them to do, at most {self.answer_sentences} sentences; empty if support has not answered",
                "type: " + " | ".join(self.types),
                "priority: " + " | ".join(self.priorities),
                "write a placeholder such as [NAME] for whatever identifies a person, an account or an order",
                "use only what is new in this text: no salutation, no closing, no text of an earlier message",
            ],
        )


def scoring_prompt(instruction: str, text: Column) -> Column:
    return F.concat(F.lit(instruction), text)


def extraction_prompt(kind: str, text: Column, rules: RecordRules = RecordRules()) -> Column:
    return F.concat(F.lit(rules.instruction(kind)), text)
