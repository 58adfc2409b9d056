"""Raw chats, emails and call transcripts to ticket records.

A raw cell holds turns such as ``Customer: …`` and ``Agent: …``, separated by a
line break or by the two characters backslash and n. Everything here works on
one row at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import classify, privacy, prompts
from ..functions.text import first_chars, strip_blanks, words
from .models import ColumnFunction, Model, model_column

# The labels that begin a turn, and those of the lines above an email's first turn.
CUSTOMER = "Customer"
REPLIERS = ("Agent", "Support")
HEADERS = ("Subject", "From", "To")

_LABELS = "|".join((CUSTOMER, *REPLIERS))
_TURN_BREAK = rf"(?:\\n|\r?\n)(?=(?:{_LABELS}):)"
_HEADER_LINE = rf"^(?:{'|'.join(HEADERS)}):"

# What a turn of an email holds besides its text, each pattern within one turn: quoted lines and the
# line that announces them, a forwarded message, a signature after its delimiter, a closing
# formula with nothing but a name after it, and disclaimers.
_NAME = r"(?:\p{Lu}[\p{L}.'’-]*[ \t]*){1,4}"
_CLOSING = r"(?:(?:Best|Kind|Warm) regards|Regards|Sincerely|Yours sincerely|Best wishes|Many thanks|Thanks|Thank you)"
_TAILS = (
    r"(?m)^[ \t]*(?:>[^\n]*|On [^\n]{1,200} wrote:[ \t]*)(?:\n|\z)",
    r"(?s)(?:\n|^)-{2,} ?(?:Original|Forwarded) [Mm]essage.*\z",
    r"(?s)(?:\n|^)-- ?\n.*\z",
    r"(?im)^[^\n]*(?:confidentiality notice|this (?:e-?mail|message)[^\n]{0,160}confidential)[^\n]*(?:\n|\z)",
    rf"(?:\n|^)[ \t]*{_CLOSING}[,.!]?\s*(?:{_NAME})?\s*\z",
)
_INTRODUCTION = r"^(?:Hi|Hello|Hey),?\s+(?:this is|my name is|I am|I.m)\s+(?:\p{Lu}[\p{L}'’-]*\s*){1,4}[.!,]\s+(?=\S)"
_GREETING = r"^(?:Hi|Hello|Hey|Dear)(?:\s+(?:(?:Mr|Ms|Mrs|Dr)\.\s+)?\p{Lu}[\p{L}'’-]*)?[.!,]\s+(?=\S)"

_FIRST_SENTENCE = r"(?s)^(.*?[.!?])(?:\s|\z)"


@dataclass(frozen=True)
class Rules:
    """How the built-in extractor fills type and priority and removes personal data.

    ``redact`` must be an SQL expression; ``names`` may be a model, and gets the
    redacted text. A chat or call has no subject line; its subject is the first sentence of the
    first customer turn, cut to ``subject_chars`` characters if that is given.
    """

    types: classify.Rules = classify.TYPE_RULES
    priorities: classify.Rules = classify.PRIORITY_RULES
    redact: Callable[[Column], Column] = privacy.redact
    names: ColumnFunction | None = None
    subject_chars: int | None = None


def _unwrapped(cell: Column) -> Column:
    """The cell without the literal quotes around it."""
    return F.regexp_replace(cell, r'(?s)^\s*"(.*)"\s*$', "$1")


def _turns(cell: Column) -> Column:
    return F.split(_unwrapped(cell), _TURN_BREAK)


def _spoken(turns: Column, *labels: str) -> Column:
    """The texts of the turns with one of ``labels``, in order."""
    prefix = "^(?:" + "|".join(labels) + r"):\s*"
    return F.transform(
        F.filter(turns, lambda t: t.rlike(prefix)),
        lambda t: _plain(F.regexp_replace(t, prefix, "")),
    )


def _unlabelled(turns: Column) -> Column:
    return F.transform(F.filter(turns, lambda t: ~t.rlike(f"^(?:{_LABELS}):")), _plain)


def _plain(text: Column) -> Column:
    return strip_blanks(F.replace(text, F.lit("\\n"), F.lit("\n")))


def _without_greeting(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _INTRODUCTION, ""), _GREETING, "")


def _without_tails(text: Column) -> Column:
    for pattern in _TAILS:
        text = strip_blanks(F.regexp_replace(text, pattern, ""))
    return text


def _first_sentence(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, _FIRST_SENTENCE, 1), F.lit("")), text)


def _joined(texts: Column) -> Column:
    """The texts joined by a space, without the empty ones; NULL when there are none."""
    # Joined once: a condition on the filtered texts would make them a second time.
    return F.nullif(F.array_join(F.filter(texts, lambda t: t != ""), " "), F.lit(""))


def _parsed(df: DataFrame, text_col: str, source: str) -> DataFrame:
    raw = F.col(text_col)
    return df.where(raw.isNotNull()).select(
        F.lit(source).alias("source"), F.md5(raw).alias("source_key"), _turns(raw).alias("_turns")
    )


def _conversation_parts(df: DataFrame, text_col: str, source: str) -> DataFrame:
    turns, asked, replied = F.col("_turns"), F.col("_asked"), F.col("_replied")
    return (
        _parsed(df, text_col, source)
        .select(
            "source",
            "source_key",
            F.transform(F.concat(_unlabelled(turns), _spoken(turns, CUSTOMER)), _without_greeting).alias("_asked"),
            F.transform(_spoken(turns, *REPLIERS), _without_greeting).alias("_replied"),
        )
        .select(
            "source",
            "source_key",
            _first_sentence(F.try_element_at(F.filter(asked, lambda t: t != ""), F.lit(1))).alias("_subject"),
            _joined(asked).alias("_body"),
            _joined(replied).alias("_answer"),
        )
    )


def chat_parts(chats: DataFrame, text_col: str = "chat") -> DataFrame:
    """Subject: first sentence of the first customer turn. Body: all customer turns.
    Answer: all agent turns. A line that begins with another label is part of its turn."""
    return _conversation_parts(chats, text_col, "chat")


def call_parts(transcripts: DataFrame, text_col: str = "transcripts") -> DataFrame:
    """As for chats, from a call transcript."""
    return _conversation_parts(transcripts, text_col, "call")


def email_parts(emails: DataFrame, text_col: str = "email") -> DataFrame:
    """Subject from the header lines above the first turn; body and answer are all turns of the
    customer and of support, each without greeting, signature, quoted lines and disclaimer."""
    turns, lines = F.col("_turns"), F.col("_lines")
    header = F.filter(lines, lambda line: line.rlike("^Subject:"))
    above = F.array_join(F.filter(lines, lambda line: ~line.rlike(_HEADER_LINE)), "\n")

    def text_of(turns_col: str) -> Column:
        return _joined(F.transform(F.col(turns_col), lambda t: _without_greeting(_without_tails(t))))

    return (
        _parsed(emails, text_col, "email")
        .withColumn("_lines", F.split(F.array_join(_unlabelled(turns), "\n"), "\r?\n"))
        .select(
            "source",
            "source_key",
            strip_blanks(F.regexp_replace(F.try_element_at(header, F.lit(1)), "^Subject:", "")).alias("_subject"),
            F.concat(F.array(above), _spoken(turns, CUSTOMER)).alias("_asked"),
            _spoken(turns, *REPLIERS).alias("_replied"),
        )
        .select("source", "source_key", "_subject", text_of("_asked").alias("_body"), text_of("_replied").alias("_answer"))
    )


def to_records(parts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Records from the parts of one channel or of a union of channels.

    The finished fields pass through a generator. A filter on them (such as the
    one for complete records) then stays above it, instead of being pushed down
    with a second copy of the whole parsing. The three texts are redacted by one
    lambda over an array: written out three times, the generated method would
    be longer than the JVM is willing to compile.
    """
    about = F.concat(F.coalesce("_subject", F.lit("")), F.lit(" "), F.coalesce("_body", F.lit("")))
    found, clean = F.col("_words"), F.col("_clean")
    subject = F.col("_subject") if rules.subject_chars is None else first_chars(F.col("_subject"), rules.subject_chars)
    names = rules.names or (lambda text: text)
    fields = {
        "subject": names(clean[0]),
        "body": names(clean[1]),
        "answer": names(clean[2]),
        "type": classify.ticket_type(found, rules.types),
        "priority": classify.ticket_priority(found, rules.priorities),
    }
    return (
        parts.select(
            "source",
            "source_key",
            words(about).alias("_words"),
            F.transform(F.array(subject, "_body", "_answer"), lambda text: rules.redact(text)).alias("_clean"),
        )
        .select("source", "source_key", *[value.alias(name) for name, value in fields.items()])
        .select("source", "source_key", F.inline(F.array(F.struct(*fields))))
    )


def normalize_chats(chats: DataFrame, text_col: str = "chat", rules: Rules = Rules()) -> DataFrame:
    return to_records(chat_parts(chats, text_col), rules)


def normalize_emails(emails: DataFrame, text_col: str = "email", rules: Rules = Rules()) -> DataFrame:
    return to_records(email_parts(emails, text_col), rules)


def normalize_calls(transcripts: DataFrame, text_col: str = "transcripts", rules: Rules = Rules()) -> DataFrame:
    return to_records(call_parts(transcripts, text_col), rules)


def forms_passthrough(forms: DataFrame) -> DataFrame:
    """Forms already have the fields; they only get their source and key."""
    fields = schemas.FORMS.fieldNames()
    text = [F.col(name).cast("string").alias(name) for name in fields]
    content = F.concat_ws("\x1f", *[F.coalesce(F.col(name).cast("string"), F.lit("\x00")) for name in fields])
    return forms.select(F.lit("form").alias("source"), F.md5(content).alias("source_key"), *text)


def model_extractor(model: Model) -> ColumnFunction:
    """An injected extractor: list of prompts to list of dicts with the form fields."""
    return model_column(model, schemas.FORMS)


def extract(df: DataFrame, text_col: str, source: str, extractor: ColumnFunction) -> DataFrame:
    """Records from an extractor that answers a prompt with a struct of the fields."""
    raw = F.col(text_col)
    prompt = prompts.extraction_prompt(source, raw)
    return (
        df.where(raw.isNotNull())
        .select(F.lit(source).alias("source"), F.md5(raw).alias("source_key"), extractor(prompt).alias("_record"))
        .select("source", "source_key", "_record.*")
    )


def transcribe(objects: DataFrame, transcriber: ColumnFunction, out: str = "transcripts") -> DataFrame:
    """The object listing plus a transcript of each file's content."""
    return objects.withColumn(out, transcriber(F.col("content"))).drop("content")
