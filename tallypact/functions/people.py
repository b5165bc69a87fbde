"""Group claims and roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_groups(claim: Column) -> Column:
    """Groups of a claim such as ``[provider finance]`` or ``provider,finance``."""
    bare = F.regexp_replace(F.trim(F.coalesce(claim, F.lit(""))), r"^[\[\]]+|[\[\]]+$", "")
    words = F.split(F.trim(F.replace(bare, F.lit(","), F.lit(" "))), r"\s+")
    return F.filter(
        F.transform(words, lambda w: F.regexp_replace(w, "^[\"']+|[\"']+$", "")),
        lambda w: w != "")


def is_provider(groups: Column) -> Column:
    return F.array_contains(groups, "provider") | F.array_contains(groups, "finance")


def group_role(groups: Column) -> Column:
    return (F.when(F.array_contains(groups, "provider"), "provider")
            .when(F.array_contains(groups, "finance"), "finance").otherwise("client"))
