"""Field-survey point observations on Spark: clean, correct, merge, summarise."""

from firnline.session import survey_session

__all__ = ["survey_session"]
