"""Vehicle inventory: composition, filters, assignment batches and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact.functions import billing as bill_fn
from tallypact.functions import fleet as fn
from tallypact.operators.ordered import with_next
from tallypact.operators.records import dimension
from tallypact.plans.billing import config_dues, fleet_sizes, recurring_dues

AXES = {
    "status": fv.VEHICLE_STATUSES, "ownership": fv.OWNERSHIPS,
    "duty_band": list(fv.DUTY_BANDS), "body_class": fv.BODY_CLASSES,
    "powertrain": fv.POWERTRAINS,
}


def composition(vehicles: DataFrame) -> DataFrame:
    """Count and share of every code on the five axes, in one pass over the inventory."""
    typed = vehicles.withColumn("duty_band", fn.duty_band(F.col("body_class")))
    sets = typed.groupingSets([[F.col(a)] for a in AXES], *[F.col(a) for a in AXES])
    counted = sets.agg(F.count("*").alias("vehicles"), F.grouping_id().alias("gid"))
    # A grouping set leaves one axis; its bit is the only zero in the grouping id.
    width = len(AXES)
    axis = code = None
    for i, name in enumerate(AXES):
        hit = F.col("gid") == (2 ** width - 1) - 2 ** (width - 1 - i)
        axis = F.when(hit, name) if axis is None else axis.when(hit, name)
        code = F.when(hit, F.col(name)) if code is None else code.when(hit, F.col(name))
    rows = [(a, c, i) for a, codes in AXES.items() for i, c in enumerate(codes)]
    order = dimension(vehicles.sparkSession, rows, "axis string, code string, position int")
    found = counted.select(axis.alias("axis"), code.alias("code"), "vehicles")
    totals = found.groupBy("axis").agg(F.sum("vehicles").alias("total"))
    return (order.join(found, ["axis", "code"]).join(totals, "axis")
            .select("axis", "code", "position", "vehicles",
                    bill_fn.pct(F.col("vehicles"), F.col("total")).alias("share")))


def inventory_figures(vehicles: DataFrame) -> DataFrame:
    """Headline counts, utilisation and electrified share.

    Utilisation divides all assigned units by the provider's units less all retired ones.
    """
    own, status = F.col("ownership"), F.col("status")
    row = vehicles.agg(
        F.count("*").alias("total"), F.count_if(status == "IN_STOCK").alias("available"),
        F.count_if(status == "ASSIGNED").alias("assigned"),
        F.count_if(own == "CUSTOMER_OWNED").alias("customer_owned"),
        F.count_if(own == "PROVIDER_OWNED").alias("provider_owned"),
        F.count_if(status == "RETIRED").alias("retired"),
        F.count_if(F.col("powertrain").isin(fv.ELECTRIFIED)).alias("electrified"))
    leasable = F.col("provider_owned") - F.col("retired")
    return row.select(
        "total", "available", "assigned", "customer_owned", "provider_owned",
        F.when(leasable > 0, bill_fn.pct(F.col("assigned"), leasable)).otherwise(0.0)
        .alias("utilisation"),
        bill_fn.pct(F.col("electrified"), F.col("total")).alias("electrified_share"))


def customer_vehicles(vehicles: DataFrame, engagements: DataFrame) -> DataFrame:
    """Vehicles by customer: those on its engagements, and unassigned ones it owns."""
    owners = engagements.select("engagement_id", "customer_id")
    on_engagements = vehicles.filter("engagement_id is not null").join(owners, "engagement_id")
    idle = (vehicles.filter("engagement_id is null and ownership = 'CUSTOMER_OWNED'")
            .withColumn("customer_id", F.col("owner_customer_id")))
    return on_engagements.unionByName(idle)


def resync(engagements: DataFrame, vehicles: DataFrame, terms: DataFrame | None = None,
           lines: DataFrame | None = None) -> DataFrame:
    """Fleet and dues re-derived from the inventory; live engagements keep what is stored.

    Dues are those of the billed ``lines`` where they are given, else of all live ``terms``.
    """
    fresh = fleet_sizes(engagements, vehicles)
    found = recurring_dues(terms, fresh) if lines is None else config_dues(lines, fresh)
    dues = found.select("engagement_id", "monthly_recurring")
    locked = bill_fn.fleet_locked(F.col("status"))
    return (fresh.join(dues, "engagement_id")
            .withColumn("locked", locked)
            .withColumn("fleet_size", F.when(F.col("locked"), F.col("stored_fleet"))
                        .otherwise(F.col("fleet_size")).cast("bigint"))
            .withColumn("monthly_recurring", F.when(F.col("locked"), F.col("stored_dues"))
                        .otherwise(F.col("monthly_recurring"))))


def decide_assignments(requests: DataFrame, vehicles: DataFrame,
                       engagements: DataFrame) -> DataFrame:
    """Assignment requests with the reason each is refused, or NULL when it is accepted.

    ``requests`` has vehicle_id and target_engagement.
    """
    targets = engagements.select(F.col("engagement_id").alias("target_engagement"),
                                 F.col("customer_id").alias("target_customer"))
    stock = vehicles.select("vehicle_id", "status", "ownership", "owner_customer_id",
                            F.col("engagement_id").alias("current_engagement"),
                            F.lit(True).alias("known"))
    elsewhere = F.col("current_engagement") != F.col("target_engagement")
    other_owner = ((F.col("ownership") == "CUSTOMER_OWNED")
                   & (F.col("owner_customer_id") != F.col("target_customer")))
    reason = (F.when(F.col("target_customer").isNull(), "engagement not found")
              .when(F.col("known").isNull(), "vehicle not found")
              .when(elsewhere, "vehicle is already assigned")
              .when(F.col("status") == "RETIRED", "vehicle is retired")
              .when(other_owner, "vehicle belongs to a different customer"))
    return (requests.join(stock, "vehicle_id", "left")
            .join(targets, "target_engagement", "left")
            .select("vehicle_id", "target_engagement", "target_customer",
                    reason.alias("refused")))


def assign(vehicles: DataFrame, decided: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(vehicles, history) after a batch of decided requests; refused ones change nothing.

    ``history`` holds the rows to append: vehicle_id, engagement_id and assigned_at. Of several
    accepted requests for one vehicle the one with the smallest engagement counts.
    """
    taken = (decided.filter("refused is null").groupBy("vehicle_id")
             .agg(F.min("target_engagement").alias("taken_by")))
    to = F.col("taken_by")
    units = (vehicles.join(taken, "vehicle_id", "left")
             .withColumn("status", F.when(to.isNotNull(), "ASSIGNED").otherwise(F.col("status")))
             .withColumn("engagement_id", F.coalesce(to, "engagement_id")).drop("taken_by"))
    history = taken.select("vehicle_id", to.alias("engagement_id"), at.alias("assigned_at"))
    return units, history


def release(vehicles: DataFrame, released: DataFrame) -> DataFrame:
    """Vehicles after a batch of releases; a customer's unit is never back in stock."""
    gone = released.select("vehicle_id").distinct().withColumn("released", F.lit(True))
    back = F.col("released").isNotNull()
    return (vehicles.join(gone, "vehicle_id", "left")
            .withColumn("status", F.when(back, fn.released_status(F.col("ownership")))
                        .otherwise(F.col("status")))
            .withColumn("engagement_id", F.when(~back, F.col("engagement_id")))
            .drop("released"))


def assignment_intervals(history: DataFrame, order: list[str]) -> DataFrame:
    """Append-only assignments as intervals: each ends when the vehicle's next one starts."""
    return with_next(history, "vehicle_no", order, "assigned_at", "assigned_until")
