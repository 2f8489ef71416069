"""The state of tickets after their log of actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import folded

#: Hours to a resolution by priority; others as normal.
RESOLVE_HOURS = {"high": 24, "normal": 72, "low": 168}


def _apply(state: dict, row: dict) -> None:
    at, kind = row["t"], row["action"]
    if state["due"] is None:
        state["due"] = row["created"] + 3600 * RESOLVE_HOURS[state["priority"]]
    closed = state["status"] == "closed"
    if kind in ("close", "open"):
        status = "closed" if kind == "close" else "pending"
        if status != state["status"]:
            state["status"], state["resolved"] = status, at if kind == "close" else None
    elif kind in ("reply", "note"):
        if state["answered"] is None:
            state["answered"] = at
        if kind == "reply" and state["status"] == "pending":
            state["status"], state["resolved"] = "in_progress", None
    elif kind == "escalate" and state["escalated"] is None:
        state["escalated"] = at
        if state["priority"] != "high":
            state["priority"], state["due"] = "high", row["created"] + 3600 * RESOLVE_HOURS["high"]
    elif kind == "customer" and closed:
        state.update(status="pending", resolved=None, reopened=state["reopened"] + 1, due=at + 3600 * RESOLVE_HOURS[state["priority"]])


def ticket_states(actions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, status, priority, answered, resolved, escalated, due (seconds) and reopened after all actions in order.

    actions has action, t (its time in seconds) and created (the ticket's). A ticket begins pending, with normal priority
    and its resolution due from creation. close and open set the status if it changes: closing stamps resolved, opening
    clears it. The first reply or note stamps answered, once; a reply takes a pending ticket into progress. The first
    escalation raises the priority and counts the due time anew from creation. A customer's message opens a closed ticket
    again, counts that, and the due time runs from now. Other actions change nothing.
    """
    first = lambda: {"status": "pending", "priority": "normal", "answered": None, "resolved": None, "escalated": None, "due": None, "reopened": 0}
    return folded(actions.withColumn("t", F.col("t").cast("long")), key, order, ["action", "t", "created"], first, _apply, "status string, priority string, answered long, resolved long, escalated long, due long, reopened long")
