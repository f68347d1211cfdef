"""One evaluation as one job: progress, snapshots, and new versions of tasks and enrolments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from cairnwise.operators import progress as p
from cairnwise.operators.rule_index import StoredRules
from cairnwise.operators.rules import RuleSet
from cairnwise.session import materialise
from cairnwise.sources.versions import Versions


@dataclass
class Evaluation:
    progress: DataFrame
    snapshots: DataFrame
    tasks: DataFrame
    enrolments: DataFrame


def evaluate(
    tasks: DataFrame, enrolments: DataFrame, snapshots: DataFrame, finds: DataFrame, items: DataFrame,
    rules: RuleSet | StoredRules, as_of: str, force: bool = False, and_only: bool = True, strict: bool = False,
) -> Evaluation:
    """Evaluates every enrolment that is not completed with a stored snapshot.

    ``snapshots`` of the result are the new ones alone; tasks and enrolments
    are whole tables. Task progress is written once, since three tables follow from it.
    """
    fresh, _ = p.split_completed(enrolments, snapshots)
    fresh = materialise(fresh, "evaluated-enrolments")
    due = tasks.join(fresh.select("uc_id"), "uc_id", "left_semi")
    progress = materialise(p.task_progress(due, finds, items, rules, force, and_only), "task-progress")
    rolled = materialise(p.enrolment_progress(fresh, progress, strict), "enrolment-progress")
    return Evaluation(
        progress,
        p.nested_snapshots(progress, rolled, as_of),
        p.written_tasks(tasks, progress),
        p.written_enrolments(enrolments, rolled, as_of),
    )


def publish(result: Evaluation, tables: Versions) -> int:
    """Snapshots are appended, tasks and enrolments replaced, all in one commit."""
    return tables.commit({"tasks": result.tasks, "enrolments": result.enrolments}, {"snapshots": result.snapshots})
