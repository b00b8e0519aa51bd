"""Records of decisions: from references, reviews and answers to rows of one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid.functions import keys as K
from lodegrid.functions.text import truthy

# The columns of decisions, and of what a reviewer is shown.
COLUMNS = (
    "paper_id", "doi", "title", "year", "venue", "scis_rank", "decision", "criterion", "f1_provisional", "preprint_paper",
    "rationale", "timestamp", "first_decision_timestamp", "rater_initials", "session_id", "pass_number",
)
SHOWN = ("title", "abstract", "source", "year", "scis_rank", "doi", "preprint_flag", "ic3_flag", "retracted_flag", "paratext_flag")
NO_ABSTRACT = "(not available — snowball reference from seed PDF)"
NO_VENUE = "(snowball ref — venue unknown)"


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def shown_reference(refs: DataFrame) -> DataFrame:
    """What a reviewer is shown of a reference: title, year and DOI; it has no abstract and no flags."""
    known = {"title", "year", "doi"}
    return refs.select(*[(_text(refs, c) if c in known else F.lit(NO_ABSTRACT if c == "abstract" else "")).alias(c) for c in SHOWN])


def reference_id(refs: DataFrame) -> Column:
    """doi:..., or hash:... of title and year."""
    doi = _text(refs, "doi")
    return F.when(doi != "", F.concat(F.lit("doi:"), doi)).otherwise(F.concat(F.lit("hash:"), K.title_year_hash(_text(refs, "title"), _text(refs, "year"))))


def from_answers(answers: DataFrame, session: str, rater: str, now: str) -> DataFrame:
    """Decisions on references (doi, title, year) by a model's answer (decision, criterion, f1_provisional, preprint_paper, rationale).

    Deferring excludes by EC4, and the rationale says so; a rationale that says where it comes from is left as it is.
    """
    deferred = _text(answers, "decision") == "defer"
    note = F.lit("[snowball-forced-exclude] LLM deferred due to insufficient context (abstract unavailable from seed citation). ")
    rationale = F.when(deferred, F.concat(note, _text(answers, "rationale"))).otherwise(_text(answers, "rationale"))
    criterion = F.when(deferred & (_text(answers, "criterion") == ""), "EC4").otherwise(_text(answers, "criterion"))
    values = {
        "paper_id": reference_id(answers), "doi": _text(answers, "doi"), "title": _text(answers, "title"), "year": _text(answers, "year"), "venue": F.lit(NO_VENUE),
        "decision": F.when(deferred, "exclude").otherwise(_text(answers, "decision")), "criterion": criterion, "f1_provisional": _text(answers, "f1_provisional"),
        "preprint_paper": F.coalesce(F.nullif(_text(answers, "preprint_paper"), F.lit("")), F.lit("unknown")),
        "rationale": F.when(rationale.startswith("["), rationale).otherwise(F.concat(F.lit("[LLM-snowball] "), rationale)),
        "timestamp": F.lit(now), "first_decision_timestamp": F.lit(now), "rater_initials": F.lit(rater), "session_id": F.lit(session), "pass_number": F.lit("snowball"),
    }
    return answers.select(*[values.get(c, F.lit("")).alias(c) for c in COLUMNS])


def from_reviews(reviews: DataFrame, session: str, rater: str, now: str) -> DataFrame:
    """Decisions from approved reviews; a rationale that the rater has overruled says so."""
    own = {
        "rationale": F.when(truthy(_text(reviews, "rater_override")), F.concat(F.lit("[rater-override] "), _text(reviews, "rationale"))).otherwise(_text(reviews, "rationale")),
        "timestamp": F.lit(now), "first_decision_timestamp": _text(reviews, "timestamp"), "rater_initials": F.lit(rater), "session_id": F.lit(session), "pass_number": F.lit("llm-approved"),
    }
    return reviews.select(*[own.get(c, _text(reviews, c)).alias(c) for c in COLUMNS])
