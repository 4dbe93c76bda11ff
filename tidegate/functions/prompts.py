"""Texts of the prompts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The topic where none is given, and the error where no task is.
GENERAL, NO_TASK = "general overview", "Parameter 'task' is required."
#: Templates where the caller brings none.
ANALYZE = "Topic: {}. Objects:\n{}\n"
CODE = (
    "Task: {}.\n\nAnswer as an experienced developer of this platform, with code that solves the task. What is expected of it:\n"
    "- failures are caught where they may arise\n- whatever runs on the server stands apart from what runs on the client\n"
    "- components are called asynchronously, with callbacks\n- comments say why the business needs a step\n- variables are named after what they hold\n\n"
    "Tools at hand: 'evaluate' for a single expression, 'execute' for a whole draft, whose value is what it leaves in Result."
)


def filled(template: str, *values: Column) -> Column:
    """The template with each {} replaced by a value."""
    parts = template.split("{}")
    return F.concat(F.lit(parts[0]), *(x for v, p in zip(values, parts[1:], strict=True) for x in (v, F.lit(p))))


def analyze(topic: Column, summary: Column, template: str = ANALYZE) -> Column:
    """Takes the general topic where the topic is missing or empty."""
    given = F.coalesce(topic, F.lit(""))
    return filled(template, F.when(given == "", F.lit(GENERAL)).otherwise(given), summary)


def code(task: Column, template: str = CODE) -> Column:
    """Null without a task."""
    return F.when(F.coalesce(task, F.lit("")) != "", filled(template, task))
