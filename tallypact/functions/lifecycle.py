"""Lifecycle codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallypact import fixed_values as fv

# One letter per status, so the state of a whole machine is one short string.
LETTERS = {status: chr(ord("A") + i) for i, status in enumerate(fv.STATUSES)}
IDENTITY = "".join(LETTERS.values())


def stage_of(status: Column) -> Column:
    chain = None
    for stage, (_label, statuses) in fv.STAGES.items():
        hit = status.isin(statuses)
        chain = F.when(hit, stage) if chain is None else chain.when(hit, stage)
    return chain.otherwise(F.lit("NEGOTIATIONS"))


def stage_label(stage: Column) -> Column:
    chain = None
    for key, (label, _statuses) in fv.STAGES.items():
        chain = F.when(stage == key, label) if chain is None else chain.when(stage == key, label)
    return chain


def cycle_label(cycle: Column) -> Column:
    return F.when(cycle <= 1, "Original agreement").otherwise(
        F.concat(F.lit("Amendment "), (cycle - 1).cast("string")))


def can_amend(status: Column) -> Column:
    return F.coalesce(status == "ACTIVE", F.lit(False))


def visible_to(action: Column, is_client: Column) -> Column:
    return ~is_client | action.isin(fv.CLIENT_VISIBLE_ACTIONS)


def status_letter(status: Column) -> Column:
    chain = None
    for name, letter in LETTERS.items():
        chain = F.when(status == name, letter) if chain is None else chain.when(
            status == name, letter)
    return chain


def letter_status(letter: Column) -> Column:
    chain = None
    for name, key in LETTERS.items():
        chain = F.when(letter == key, name) if chain is None else chain.when(letter == key, name)
    return chain


def moves(action: Column, role: Column) -> tuple[Column, Column]:
    """(sources, targets) letters of the legal moves of an action by a role.

    ``translate(state, sources, targets)`` applies them; an event that is not legal from a state
    leaves that state alone.
    """
    legal: dict[str, list[tuple[str, str, list[str]]]] = {}
    for source, act, target, roles in fv.TRANSITIONS:
        legal.setdefault(act, []).append((LETTERS[source], LETTERS[target], roles))
    src = dst = None
    for act, rows in legal.items():
        hit = (action == act) & role.isin(rows[0][2])
        sources, targets = "".join(r[0] for r in rows), "".join(r[1] for r in rows)
        src = F.when(hit, sources) if src is None else src.when(hit, sources)
        dst = F.when(hit, targets) if dst is None else dst.when(hit, targets)
    return src.otherwise(F.lit("")), dst.otherwise(F.lit(""))


def action_moves(action: Column) -> Column:
    """Letters of the states an action may start from, whoever performs it."""
    legal: dict[str, str] = {}
    for source, act, _target, _roles in fv.TRANSITIONS:
        legal[act] = legal.get(act, "") + LETTERS[source]
    chain = None
    for act, sources in legal.items():
        chain = F.when(action == act, sources) if chain is None else chain.when(
            action == act, sources)
    return chain.otherwise(F.lit(""))
