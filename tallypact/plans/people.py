"""People on engagements: directories, candidates, recipients and what each may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact.operators.records import dimension


def person_directory(memberships: DataFrame, engagements: DataFrame, order: Column) -> DataFrame:
    """Customer-side people folded from their memberships.

    The first name and phone known in ``order`` win. Engagements and customers are counted here
    and listed as rows by :func:`person_customers`, so one very busy person is not one huge cell.
    """
    owners = engagements.select("engagement_id", "customer_id")
    clients = memberships.filter("role = 'client'").join(owners, "engagement_id", "left")

    def first_known(col):
        return F.min_by(col, F.when(F.col(col).isNotNull(), order)).alias(col)

    return clients.groupBy("user_id").agg(
        F.min("email").alias("email"), first_known("name"), first_known("phone"),
        F.count("customer_id").alias("engagements"),
        F.count_distinct("customer_id").alias("customers"))


def person_customers(memberships: DataFrame, engagements: DataFrame,
                     order: Column) -> DataFrame:
    """(person, customer) pairs with when they first met."""
    owners = engagements.select("engagement_id", "customer_id", "client_name")
    return (memberships.filter("role = 'client'").join(owners, "engagement_id")
            .groupBy("user_id", "customer_id", "client_name")
            .agg(F.min(order).alias("first_seen")))


def staff(memberships: DataFrame, directory: DataFrame) -> DataFrame:
    """Ids of provider-side people: non-client memberships and the directory."""
    return (memberships.filter("role <> 'client'").select("user_id")
            .union(directory.select("user_id")).distinct())


def providers(memberships: DataFrame, directory: DataFrame) -> DataFrame:
    """Provider list; a directory entry wins over one derived from memberships."""
    derived = (memberships.filter("role <> 'client'").groupBy("user_id")
               .agg(F.max_by(F.struct("email", "name"), "engagement_id").alias("p"))
               .select("user_id", "p.email", "p.name", F.lit("membership").alias("source")))
    listed = directory.select("user_id", "email", "name", F.lit("directory").alias("source"))
    only_derived = derived.join(listed, "user_id", "left_anti")
    return listed.unionByName(only_derived)


def candidates(people: DataFrame, customers_of: DataFrame, targets: DataFrame,
               memberships: DataFrame, staff_ids: DataFrame) -> DataFrame:
    """People of a target's customer who are neither members of the target nor staff.

    ``targets`` has engagement_id and customer_id. Both exclusions are anti joins.
    """
    known = customers_of.select("user_id", "customer_id").distinct()
    pairs = (targets.select("engagement_id", "customer_id").join(known, "customer_id")
             .join(memberships.select("engagement_id", "user_id").distinct(),
                   ["engagement_id", "user_id"], "left_anti")
             .join(staff_ids, "user_id", "left_anti"))
    return pairs.join(people.select("user_id", "name", "email"), "user_id")


def shortlist(candidates_: DataFrame, size: int = 25) -> DataFrame:
    """The first candidates per engagement by name, beside the uncapped total."""
    shown = F.lower(F.coalesce("name", "email"))
    per = Window.partitionBy("engagement_id").orderBy(shown, "user_id")
    total = candidates_.groupBy("engagement_id").agg(F.count("*").alias("total"))
    return (candidates_.withColumn("position", F.row_number().over(per))
            .filter(F.col("position") <= size).join(total, "engagement_id"))


def search_people(people: DataFrame, needle: str) -> DataFrame:
    """People whose name or address contains the text, ignoring case."""
    hay = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), "email"))
    return people.filter(hay.contains(needle.strip().lower()))


def visible_engagements(engagements: DataFrame, memberships: DataFrame, user_id,
                        is_provider: bool) -> DataFrame:
    """Engagements a person may read: all for the provider side, else those they belong to."""
    if is_provider:
        return engagements
    mine = memberships.filter(F.col("user_id") == user_id).select("engagement_id")
    return engagements.join(mine, "engagement_id", "left_semi")


def routes(spark) -> DataFrame:
    rows = [(action, template, role) for action, sends in fv.NOTIFICATION_ROUTES.items()
            for template, roles in sends for role in roles]
    return dimension(spark, rows, "action string, template string, role string")


def outbox(events: DataFrame, memberships: DataFrame) -> DataFrame:
    """(event, template, recipient) rows for lifecycle events.

    ``events`` has event_id, engagement_id and action. Works on a stream as well: both other
    sides are static.
    """
    members = memberships.select("engagement_id", "role", "user_id", "email")
    routed = events.join(F.broadcast(routes(events.sparkSession)), "action")
    return routed.join(members, ["engagement_id", "role"]).select(
        "event_id", "engagement_id", "template", "user_id", "email")


def customer_contacts(memberships: DataFrame, engagements: DataFrame) -> DataFrame:
    """Each customer's distinct client contacts, as seen on the first engagement they are on."""
    owners = engagements.select("engagement_id", "customer_id")
    rows = memberships.filter("role = 'client'").join(owners, "engagement_id")
    return rows.groupBy("customer_id", "user_id").agg(
        F.min_by("email", "engagement_id").alias("email"),
        F.min("engagement_id").alias("first_engagement"))
