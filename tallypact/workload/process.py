"""Lifecycle, people and fleet queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact import views
from tallypact.functions import fleet as fleet_fn
from tallypact.functions import lifecycle as lc
from tallypact.operators.ordered import with_position
from tallypact.operators.records import dimension, last_by
from tallypact.plans import documents, fleet, lifecycle, migrations, people
from tallypact.workload import oracle_views as ov
from tallypact.workload.agreements import SQL_SLOTS, slotted_cycles
from tallypact.workload.money import ratio_sql
from tallypact.workload.registry import query
from tallypact.workload.scalars import SQL_DUTY

CYCLE_COLS = "engagement_id, submission_id, cycle, status"


def _ranked(preferred: str, source: str = "submissions") -> str:
    return (f"select {CYCLE_COLS} from (select *, row_number() over (partition by engagement_id "
            f"order by {preferred} desc, cycle desc, created_at desc, submission_id desc) as rn "
            f"from {source}) where rn = 1")


# --- cycles ----------------------------------------------------------------------------------
@query("F1_cycle_in_force", uses="submissions",
       sql=_ranked("case when status = 'ACTIVE' then 1 else 0 end"))
def cycle_in_force(spark, d):
    return lifecycle.cycle_in_force(views.submissions(spark, d)).drop("created_at")


@query("F2_open_cycle", uses="submissions", sql=f"""
select o.*, l.submission_id as live_submission_id from (
 {_ranked("case when status <> 'ACTIVE' then 1 else 0 end")}) o left join (
 select engagement_id as eid, submission_id from (
 {_ranked("case when status = 'ACTIVE' then 1 else 0 end")}) where status = 'ACTIVE') l
on eid = o.engagement_id""")
def open_cycle(spark, d):
    cycles = views.submissions(spark, d)
    live = lifecycle.live_cycle(cycles).select(
        "engagement_id", F.col("submission_id").alias("live_submission_id"))
    return (lifecycle.open_cycle(cycles).drop("created_at")
            .join(live, "engagement_id", "left"))


@query("F6_next_cycle", uses="submissions", sql="""
select engagement_id, max(cycle) + 1 as next_cycle from submissions group by engagement_id""")
def next_cycle(spark, d):
    return lifecycle.next_cycle(views.submissions(spark, d))


@query("F10_waiting_time", uses="submissions", sql=f"""
select engagement_id, date_diff('day', created_at, {ov.AS_OF}) as days_waiting from (
 select *, row_number() over (partition by engagement_id order by
  case when status = 'ACTIVE' then 1 else 0 end desc, cycle desc) as rn from submissions)
where rn = 1""")
def waiting_time(spark, d):
    return lifecycle.cycle_in_force(views.submissions(spark, d)).select(
        "engagement_id", F.datediff(views.as_of(), "created_at").alias("days_waiting"))


@query("G6_ordered_lists", uses="audit_events submissions vehicles", sql="""
select 'audit' as list, cast(submission_id as varchar) as owner, cast(event_id as varchar) as id,
  row_number() over (partition by submission_id order by ts desc, event_id) as position
from audit_events
union all select 'cycles', cast(engagement_id as varchar), cast(submission_id as varchar),
  row_number() over (partition by engagement_id order by cycle, created_at, submission_id)
from submissions
union all select 'vehicles', cast(engagement_id as varchar), vehicle_id,
  row_number() over (partition by engagement_id order by vehicle_id) from vehicles""")
def ordered_lists(spark, d):
    """Every row of each list with its place in the list of its owner."""
    def listed(df, name, owner, key, order):
        return with_position(df, owner, order, "position").select(
            F.lit(name).alias("list"), F.col(owner).cast("string").alias("owner"),
            F.col(key).cast("string").alias("id"), "position")

    events = views.audit_events(spark, d).withColumn("back", -F.unix_micros("ts"))
    return (listed(events, "audit", "submission_id", "event_id", ["back", "event_id"])
            .unionByName(listed(views.submissions(spark, d), "cycles", "engagement_id",
                                "submission_id", ["cycle", "created_at", "submission_id"]))
            .unionByName(listed(views.vehicles(spark, d), "vehicles", "engagement_id",
                                "vehicle_id", ["vehicle_id"])))


ov.VIEWS["transitions"] = "select * from (values " + ", ".join(
    f"('{s}', '{a}', '{t}', '{r}')" for s, a, t, roles in fv.TRANSITIONS for r in roles
) + ") v(source, act, target, role)"
SQL_STATUS_OF = ov.case_of("event_id % 11", dict(enumerate(fv.STATUSES)))


@query("D14_transition_lookup", uses="audit_events transitions", sql=f"""
select event_id, status, action, actor_role, target from (select *, {SQL_STATUS_OF} as status
 from audit_events) left join transitions on status = source and action = act
 and actor_role = role""")
def transition_lookup(spark, d):
    rows = [(s, a, r, t) for s, a, t, roles in fv.TRANSITIONS for r in roles]
    table = dimension(spark, rows,
                      "status string, action string, actor_role string, target string")
    status = views.by_value(F.col("event_id") % 11, dict(enumerate(fv.STATUSES)))
    return (views.audit_events(spark, d)
            .select("event_id", status.alias("status"), "action", "actor_role")
            .join(F.broadcast(table), ["status", "action", "actor_role"], "left"))


ov.VIEWS["replayed"] = """with recursive ev as (select *, row_number() over (
   partition by submission_id order by ts, event_id) as rn from audit_events),
 walk as (select submission_id, cast(0 as bigint) as rn, cast(null as bigint) as event_id,
   cast(null as timestamp) as ts, cast(null as varchar) as action, cast(null as varchar) as
   actor_role, cast(null as varchar) as status_before, 'DRAFT' as status_after
   from (select distinct submission_id from ev)
  union all select e.submission_id, e.rn, e.event_id, e.ts, e.action, e.actor_role,
   w.status_after, coalesce(t.target, w.status_after)
   from walk w join ev e on e.submission_id = w.submission_id and e.rn = w.rn + 1
   left join transitions t on t.source = w.status_after and t.act = e.action
    and t.role = e.actor_role)
 select *, exists(select 1 from transitions t where t.source = status_before and t.act = action
   and t.role = actor_role) as accepted,
  exists(select 1 from transitions t where t.source = status_before and t.act = action) as known
 from walk where rn > 0"""


@query("J18_lifecycle_replay", uses="audit_events transitions replayed", sql="""
select submission_id, event_id, status_before, accepted, status_after, case when accepted
  then null when known then concat('role ', actor_role, ' may not perform ', action)
  else concat(action, ' is not allowed from ', status_before) end as reason from replayed""")
def lifecycle_replay(spark, d):
    return lifecycle.replay(views.audit_events(spark, d)).drop("ts", "action", "actor_role")


ov.VIEWS["final_states"] = """select submission_id, status_after as final_status from replayed
  qualify row_number() over (partition by submission_id order by rn desc) = 1"""


@query("J18_final_status", uses="audit_events transitions replayed final_states",
       sql="select * from final_states")
def final_status(spark, d):
    return lifecycle.final_status(lifecycle.replay(views.audit_events(spark, d))).select(
        "submission_id", F.col("status_after").alias("final_status"))


@query("J19_status_follow_through", uses="submissions", sql="""
with last as (select engagement_id, max(cycle) as cycle from submissions group by all),
 ch as (select s.engagement_id as eid, submission_id, status, case engagement_id % 3
  when 0 then 'ACTIVE' when 1 then 'IN_UNDERWRITING' else 'CLIENT_APPROVED' end as new_status
  from submissions s join last using (engagement_id, cycle)),
 live as (select eid, count(*) filter (where s.status = 'ACTIVE' and
   s.submission_id <> ch.submission_id) as others from ch join submissions s
   on s.engagement_id = eid group by all)
select c_custkey as engagement_id, case when new_status = 'ACTIVE' or others = 0 then new_status
  else 'DRAFT' end as status from customer left join ch on eid = c_custkey
  left join live on live.eid = c_custkey""")
def status_follow_through(spark, d):
    cycles = views.submissions(spark, d)
    new = views.by_value(F.col("engagement_id") % 3, {0: "ACTIVE", 1: "IN_UNDERWRITING"},
                         "CLIENT_APPROVED")
    changes = last_by(cycles, ["engagement_id"], F.col("cycle"), ["submission_id"]).withColumn(
        "new_status", new)
    parties = views.table(spark, d, "customer").select(
        F.col("c_custkey").alias("engagement_id"), F.lit("DRAFT").alias("status"))
    return lifecycle.status_follow_through(parties, cycles, changes)


@query("J20_lifecycle_migration", uses="submissions", sql="""
with old as (select submission_id, case submission_id % 5 when 0 then 'PENDING_FINANCE_APPROVAL'
  when 1 then 'FINANCE_APPROVED' when 2 then 'CHANGES_REQUESTED_FINANCE' else status end as status
  from submissions)
select submission_id, status, status in ('PENDING_FINANCE_APPROVAL', 'FINANCE_APPROVED')
  as to_bill, case when status in ('PENDING_FINANCE_APPROVAL', 'FINANCE_APPROVED')
  then 'PENDING_BILLING_AUDIT' when status = 'CHANGES_REQUESTED_FINANCE' then 'IN_UNDERWRITING'
  else status end as new_status from old""")
def lifecycle_migration(spark, d):
    old = F.coalesce(views.by_value(F.col("submission_id") % 5, {
        0: "PENDING_FINANCE_APPROVAL", 1: "FINANCE_APPROVED",
        2: "CHANGES_REQUESTED_FINANCE"}), F.col("status"))
    return lifecycle.migrate_statuses(views.submissions(spark, d).withColumn(
        "status", old)).select("submission_id", "status", "to_bill", "new_status")


@query("J21_customer_backfill", uses="engagements", sql="""
with e as (select engagement_id, case when customer_id % 2 = 0 then upper(client_name)
  else concat(' ', client_name, ' ') end as client_name, fleet_size_override
  from engagements)
select engagement_id, sha1(lower(trim(client_name))) as customer_key,
  coalesce(fleet_size_override, 100) as fleet_size_override from e""")
def customer_backfill(spark, d):
    return linked_engagements(spark, d).select(
        "engagement_id", "customer_key", "fleet_size_override")


def linked_engagements(spark, d):
    raw = views.engagements(spark, d).withColumn(
        "client_name", F.when(F.col("customer_id") % 2 == 0, F.upper("client_name"))
        .otherwise(F.concat(F.lit(" "), "client_name", F.lit(" ")))).withColumn(
        "fleet_size", F.lit(100))
    return migrations.link_customers(raw)


@query("J21_customers_from_names", uses="engagements", sql="""
select sha1(lower(trim(client_name))) as customer_key,
  first(trim(client_name) order by engagement_id) as legal_name
from (select engagement_id, case when customer_id % 2 = 0 then upper(client_name)
  else concat(' ', client_name, ' ') end as client_name from engagements) group by 1""")
def customers_from_names(spark, d):
    return migrations.customers_from_names(linked_engagements(spark, d))


@query("J21_slots_from_legacy", uses="submissions", sql=f"""
select submission_id, {SQL_SLOTS} as slots, cycle % 2 = 1 and {SQL_SLOTS} <> '' as filled
from submissions""")
def slots_from_legacy(spark, d):
    return (migrations.fill_slots(slotted_cycles(spark, d))
            .select("submission_id", documents.slot_text("document_ids").alias("slots"), "filled"))


@query("J22_status_since", uses="engagements review_cycles cycle_in_force", sql="""
select e.engagement_id, strftime(coalesce(case when e.engagement_id % 4 = 0 then e.created_at
  end, s.created_at, e.created_at), '%Y-%m-%d') as status_since
from engagements e left join cycle_in_force s on e.engagement_id = s.engagement_id""")
def status_since(spark, d):
    stored = F.when(F.col("engagement_id") % 4 == 0, F.col("created_at"))
    cycles = views.review_cycles(spark, d).withColumn("updated_at", F.col("created_at"))
    return lifecycle.status_since(
        views.engagements(spark, d).withColumn("status_since", stored), cycles).select(
        "engagement_id", F.col("status_since").cast("string"))


@query("J28_customer_dedup", uses="customers engagements", sql="""
with c as (select customer_id, case when customer_id % 7 = 0 then 'Shared Name ' ||
  (customer_id % 5) else legal_name end as legal_name from customers)
select lower(trim(legal_name)) as name_key, count(*) as customers, min(customer_id) as first_id
from c group by 1 having count(*) > 1""")
def customer_dedup(spark, d):
    shared = F.concat(F.lit(" SHARED name "), (F.col("customer_id") % 5).cast("string"))
    named = views.customers(spark, d).withColumn(
        "legal_name", F.when(F.col("customer_id") % 7 == 0, shared)
        .otherwise(F.col("legal_name")))
    return migrations.duplicate_customers(named)


@query("J28_rename_propagation", uses="engagements", sql="""
select engagement_id, case when customer_id % 3 = 0 then 'Renamed ' || customer_id
  else client_name end as client_name from engagements""")
def rename_propagation(spark, d):
    renames = views.customers(spark, d).filter("customer_id % 3 = 0").select(
        "customer_id", F.concat(F.lit("Renamed "), F.col("customer_id").cast("string"))
        .alias("legal_name"))
    return migrations.rename_customers(views.engagements(spark, d), renames).select(
        "engagement_id", "client_name")


@query("J29_amendment_eligibility", uses="submissions", sql=f"""
with cur as ({_ranked("case when status <> 'ACTIVE' then 1 else 0 end")}),
 nx as (select engagement_id as eid, max(cycle) + 1 as next_cycle from submissions group by all),
 own as (select distinct o_custkey as eid, 1 + o_orderkey % 12 as c from orders)
select engagement_id, submission_id, status, cycle, next_cycle, status = 'ACTIVE' as can_open,
  case when cycle <= 1 then 'the original review cycle cannot be discarded'
   when status <> 'DRAFT' then
    concat('an amendment can only be discarded before it starts, not while ', status)
   when own.eid is not null then
    'remove the agreements uploaded to this amendment before discarding it' end
   as discard_refused
from cur join nx on nx.eid = engagement_id left join own on own.eid = engagement_id
 and own.c = cur.cycle""")
def amendment_eligibility(spark, d):
    docs = views.table(spark, d, "orders").select(
        F.col("o_custkey").alias("engagement_id"),
        (1 + F.col("o_orderkey") % 12).cast("int").alias("cycle"))
    return lifecycle.amendment_eligibility(views.submissions(spark, d), docs)


@query("J29_opened_amendments", uses="submissions", sql=f"""
with cur as ({_ranked("case when status <> 'ACTIVE' then 1 else 0 end")}),
 nx as (select engagement_id as eid, max(cycle) + 1 as next_cycle from submissions group by all),
 held as (select submission_id as sid, {SQL_SLOTS} as slots from submissions)
select engagement_id, submission_id as amends, next_cycle as cycle, 'DRAFT' as status, slots
from cur join nx on nx.eid = engagement_id join held on sid = submission_id
where status = 'ACTIVE'""")
def opened_amendments(spark, d):
    return (lifecycle.open_amendments(slotted_cycles(spark, d))
            .withColumn("slots", documents.slot_text("document_ids")).drop("document_ids"))


@query("J30_document_eligibility", uses="submissions", sql=f"""
select engagement_id, status, status in ({ov.quoted(fv.OPEN_FOR_DOCUMENTS)}) as can_upload,
  status in ({ov.quoted(fv.OPEN_FOR_DOCUMENTS)}) as can_delete,
  status in ({ov.quoted(fv.OPEN_FOR_EXTRACTION)}) as can_extract,
  case when status = 'DRAFT' then 'submit_for_processing' when status in ('IN_UNDERWRITING',
   'VALIDATION_FAILED', 'CHANGES_REQUESTED_CLIENT') then 'reupload' end as extract_action,
  case when status in ({ov.quoted(fv.OPEN_FOR_DOCUMENTS)}) then null when status = 'ACTIVE' then
   'this engagement is live — open an amendment to add or renew an agreement'
   else concat('agreements cannot be uploaded while the submission is ', status) end
   as upload_refused
from ({_ranked("case when status <> 'ACTIVE' then 1 else 0 end")})""")
def document_eligibility(spark, d):
    return lifecycle.document_eligibility(lifecycle.open_cycle(views.submissions(spark, d)))


# --- people ----------------------------------------------------------------------------------
@query("C4_audit_visibility", uses="audit_events", sql=f"""
select event_id, action from audit_events
where action in ({ov.quoted(fv.CLIENT_VISIBLE_ACTIONS)})""")
def audit_visibility(spark, d):
    return (views.audit_events(spark, d)
            .filter(lc.visible_to(F.col("action"), F.lit(True))).select("event_id", "action"))


ov.VIEWS["people"] = """select user_id, min(email) as email, arg_min(name, engagement_id)
   filter (where name is not null) as name, arg_min(phone, engagement_id)
   filter (where phone is not null) as phone, count(customer_id) as engagements,
   count(distinct customer_id) as customers
  from memberships m left join (select engagement_id as eid, customer_id from engagements)
   on eid = engagement_id where role = 'client' group by user_id"""
#: Every second person is a client wherever they are, so that staff and customers both exist.
ov.VIEWS["sided"] = """select * replace (case when user_id % 2 = 1 then 'client' else role end
   as role) from memberships"""
ov.VIEWS["sided_people"] = ov.VIEWS["people"].replace("memberships", "sided")
ov.VIEWS["staff"] = """select user_id from sided where role <> 'client'
  union select user_id from provider_directory"""
PEOPLE = "engagements memberships provider_directory people"


def person_rows(spark, d):
    return people.person_directory(views.memberships(spark, d), views.engagements(spark, d),
                                   F.col("engagement_id"))


@query("C7_candidate_search", uses=PEOPLE, sql="""
select user_id, email, name from people where contains(lower(concat_ws(' ', coalesce(name, ''),
 email)), 'person 1')""")
def candidate_search(spark, d):
    return people.search_people(person_rows(spark, d), "Person 1").select(
        "user_id", "email", "name")


@query("C8_tenancy_filter", uses="engagements memberships", sql="""
select user_id, count(distinct e.engagement_id) as visible from memberships m
join engagements e on e.engagement_id = m.engagement_id where role = 'client' group by user_id
union all select -1, count(*) from engagements""")
def tenancy_filter(spark, d):
    """How many engagements each client may read; -1 stands for the provider side."""
    ids = views.engagements(spark, d).select("engagement_id")
    mine = views.memberships(spark, d).filter("role = 'client'").select(
        "engagement_id", "user_id").distinct()
    return (mine.join(ids, "engagement_id", "left_semi").groupBy("user_id")
            .agg(F.count("*").alias("visible"))
            .unionByName(ids.agg(F.count("*").alias("visible"))
                         .withColumn("user_id", F.lit(-1).cast("bigint"))))


@query("D15_notification_routing", uses="audit_events memberships", sql=ov.OUTBOX_SQL)
def notification_routing(spark, d):
    events = views.audit_events(spark, d).withColumnRenamed("submission_id", "engagement_id")
    return people.outbox(events, views.memberships(spark, d))


SQL_CANDIDATES = """with target as (select customer_id, max(engagement_id) as engagement_id
   from engagements group by customer_id),
 pc as (select distinct user_id, customer_id from sided m join engagements e
  on e.engagement_id = m.engagement_id where role = 'client'),
 cand as (select t.engagement_id, pc.user_id, p.name, p.email from target t join pc
  on pc.customer_id = t.customer_id join sided_people p on p.user_id = pc.user_id
  where not exists (select 1 from sided m where m.engagement_id = t.engagement_id
   and m.user_id = pc.user_id) and pc.user_id not in (select user_id from staff))"""


def candidate_rows(spark, d):
    """Candidates for the newest engagement of each customer."""
    engagements = views.engagements(spark, d)
    members = views.memberships(spark, d).withColumn("role", F.when(
        F.col("user_id") % 2 == 1, "client").otherwise(F.col("role")))
    targets = engagements.groupBy("customer_id").agg(
        F.max("engagement_id").alias("engagement_id"))
    met = people.person_customers(members, engagements, F.col("engagement_id"))
    directory = people.person_directory(members, engagements, F.col("engagement_id"))
    return people.candidates(directory, met, targets, members,
                             people.staff(members, views.provider_directory(spark, d)))


CANDIDATES = "engagements memberships provider_directory sided sided_people staff"


@query("D16_candidates", uses=CANDIDATES, sql=f"""
{SQL_CANDIDATES} select engagement_id, user_id from cand""")
def candidates(spark, d):
    return candidate_rows(spark, d).select("engagement_id", "user_id")


@query("G4_candidate_shortlist", uses=CANDIDATES, sql=f"""
{SQL_CANDIDATES} select engagement_id, user_id, row_number() over (partition by engagement_id
  order by lower(coalesce(name, email)), user_id) as position, count(*) over (
  partition by engagement_id) as total from cand qualify position <= 25""")
def candidate_shortlist(spark, d):
    return people.shortlist(candidate_rows(spark, d)).select(
        "engagement_id", "user_id", "position", "total")


@query("E24_person_directory", uses=PEOPLE, sql="select * from people")
def person_directory(spark, d):
    return person_rows(spark, d)


@query("E24_person_customers", uses=PEOPLE, sql="""
select user_id, customer_id, client_name, min(m.engagement_id) as first_seen from memberships m
join engagements e on e.engagement_id = m.engagement_id where role = 'client' group by all""")
def person_customers(spark, d):
    return people.person_customers(views.memberships(spark, d), views.engagements(spark, d),
                                   F.col("engagement_id"))


@query("E28_customer_contacts", uses="engagements memberships vehicles", sql="""
with c as (select customer_id, count(distinct user_id) as contacts, min(m.engagement_id) as
  first_engagement from memberships m join engagements e on e.engagement_id = m.engagement_id
  where role = 'client' group by customer_id),
 v as (select customer_id as cid, count(*) as vehicles from vehicles v join engagements e
  on e.engagement_id = v.engagement_id group by all),
 n as (select customer_id as cid, count(*) as engagements from engagements group by all)
select n.cid as customer_id, engagements, coalesce(contacts, 0) as contacts,
  coalesce(vehicles, 0) as vehicles from n left join c on c.customer_id = n.cid
  left join v on v.cid = n.cid""")
def customer_contacts(spark, d):
    engagements = views.engagements(spark, d)
    contacts = (people.customer_contacts(views.memberships(spark, d), engagements)
                .groupBy("customer_id").agg(F.count("*").alias("contacts")))
    units = (views.vehicles(spark, d).filter("engagement_id is not null")
             .groupBy("engagement_id").agg(F.count("*").alias("n"))
             .join(engagements.select("engagement_id", "customer_id"), "engagement_id")
             .groupBy("customer_id").agg(F.sum("n").alias("vehicles")))
    return (engagements.groupBy("customer_id").agg(F.count("*").alias("engagements"))
            .join(contacts, "customer_id", "left").join(units, "customer_id", "left")
            .na.fill(0, ["contacts", "vehicles"]))


@query("H1_provider_list", uses="memberships provider_directory", sql="""
select user_id, email, name, 'directory' as source from provider_directory union all
select user_id, arg_max(email, engagement_id), first(name order by engagement_id desc),
 'membership' from memberships where role <> 'client'
 and user_id not in (select user_id from provider_directory) group by user_id""")
def provider_list(spark, d):
    return people.providers(views.memberships(spark, d), views.provider_directory(spark, d))


@query("H2_staff", uses="memberships provider_directory", sql="""
select user_id from memberships where role <> 'client'
union select user_id from provider_directory""")
def staff(spark, d):
    return people.staff(views.memberships(spark, d), views.provider_directory(spark, d))


@query("J31_profile_propagation", uses="memberships", sql="""
select engagement_id, user_id, case when user_id % 4 = 0 then 'New ' || user_id else name end
  as name, case when user_id % 4 = 0 then '555-9' else phone end as phone from memberships""")
def profile_propagation(spark, d):
    from tallypact.plans.changes import propagate_profile

    members = views.memberships(spark, d)
    profiles = (members.select("user_id").distinct().filter("user_id % 4 = 0")
                .select("user_id", F.concat(F.lit("New "), F.col("user_id").cast("string"))
                        .alias("name"), F.lit("555-9").alias("phone")))
    return propagate_profile(members, profiles).select("engagement_id", "user_id", "name",
                                                       "phone")


# --- fleet -----------------------------------------------------------------------------------
@query("C3_inventory_filters", uses="vehicles engagements", sql=f"""
with cv as (select v.*, e.customer_id from vehicles v join engagements e
   on e.engagement_id = v.engagement_id
  union all select v.*, owner_customer_id from vehicles v where engagement_id is null
   and ownership = 'CUSTOMER_OWNED')
select customer_id, {SQL_DUTY} as duty_band, count(*) as vehicles from cv
where status in ('ASSIGNED', 'IN_MAINTENANCE') group by all""")
def inventory_filters(spark, d):
    return (fleet.customer_vehicles(views.vehicles(spark, d), views.engagements(spark, d))
            .filter(F.col("status").isin("ASSIGNED", "IN_MAINTENANCE"))
            .groupBy("customer_id", fleet_fn.duty_band(F.col("body_class")).alias("duty_band"))
            .agg(F.count("*").alias("vehicles")))


@query("D18_assignment_rules", uses="vehicles engagements", sql="""
with rq as (select vehicle_id, coalesce(engagement_id, cast(split_part(vehicle_id, '-', 1) as
   bigint)) + case when substr(vehicle_id, length(vehicle_id), 1) = '3' then 1 else 0 end as t
  from vehicles)
select case when e.engagement_id is null then 'engagement not found'
  when v.engagement_id <> t then 'vehicle is already assigned'
  when v.status = 'RETIRED' then 'vehicle is retired'
  when ownership = 'CUSTOMER_OWNED' and owner_customer_id <> e.customer_id
   then 'vehicle belongs to a different customer' end as refused, count(*) as requests
from rq join vehicles v on v.vehicle_id = rq.vehicle_id left join engagements e
on e.engagement_id = t group by all""")
def assignment_rules(spark, d):
    return (decided_assignments(spark, d).groupBy("refused")
            .agg(F.count("*").alias("requests")))


def decided_assignments(spark, d):
    """Every vehicle asks for its own engagement; one in ten asks for the next one."""
    units = views.vehicles(spark, d)
    own = F.split("vehicle_id", "-")[0].cast("bigint")
    shift = F.when(F.col("vehicle_id").endswith("3"), 1).otherwise(0)
    asks = units.select("vehicle_id", (F.coalesce("engagement_id", own) + shift)
                        .alias("target_engagement"))
    return fleet.decide_assignments(asks, units, views.engagements(spark, d))


@query("E12_inventory_composition", uses="vehicles", sql="\nunion all\n".join(
    f"select '{axis}' as axis, code, vehicles, "
    f"{ratio_sql('vehicles * 100', '(select count(*) from vehicles)', 1)} as share from ("
    f"select {SQL_DUTY if axis == 'duty_band' else axis} as code, count(*) as vehicles "
    f"from vehicles group by 1)" for axis in fleet.AXES))
def inventory_composition(spark, d):
    return fleet.composition(views.vehicles(spark, d)).drop("position")


@query("E13_inventory_figures", uses="vehicles", sql=f"""
with v as (select count(*) as total, count(*) filter (where status = 'IN_STOCK') as available,
 count(*) filter (where status = 'ASSIGNED') as assigned,
 count(*) filter (where ownership = 'CUSTOMER_OWNED') as customer_owned,
 count(*) filter (where ownership = 'PROVIDER_OWNED') as provider_owned,
 count(*) filter (where status = 'RETIRED') as retired,
 count(*) filter (where powertrain <> 'ICE') as electrified from vehicles)
select total, available, assigned, customer_owned, provider_owned,
 {ratio_sql('assigned * 100', '(provider_owned - retired)', 1)} as utilisation,
 {ratio_sql('electrified * 100', 'total', 1)} as electrified_share from v""")
def inventory_figures(spark, d):
    return fleet.inventory_figures(views.vehicles(spark, d))


@query("E18_assigned_counts", uses="vehicles", sql="""
select cast(engagement_id as varchar) as key, count(*) as vehicles from vehicles
where engagement_id is not null group by 1
union all select concat(ownership, '/', status), count(*) from vehicles group by 1""")
def assigned_counts(spark, d):
    units = views.vehicles(spark, d)
    on = (units.filter("engagement_id is not null")
          .groupBy(F.col("engagement_id").cast("string").alias("key"))
          .agg(F.count("*").alias("vehicles")))
    return on.unionByName(units.groupBy(F.concat_ws("/", "ownership", "status").alias("key"))
                          .agg(F.count("*").alias("vehicles")))


@query("F7_assignment_intervals", uses="", sql="""
select l_partkey as vehicle_no, l_orderkey as engagement_id, strftime(l_shipdate, '%Y-%m-%d')
  as assigned_at, strftime(lead(l_shipdate) over (partition by l_partkey order by l_shipdate,
  l_orderkey, l_linenumber, l_suppkey), '%Y-%m-%d') as assigned_until from lineitem""")
def assignment_intervals(spark, d):
    history = views.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("vehicle_no"), F.col("l_orderkey").alias("engagement_id"),
        F.col("l_shipdate").cast("date").alias("assigned_at"), "l_linenumber", "l_suppkey")
    order = ["assigned_at", "engagement_id", "l_linenumber", "l_suppkey"]
    return fleet.assignment_intervals(history, order).select(
        "vehicle_no", "engagement_id", F.col("assigned_at").cast("string"),
        F.col("assigned_until").cast("string"))


@query("J24_batch_assign_release", uses="vehicles engagements", sql="""
select vehicle_id, case when status <> 'RETIRED' and engagement_id % 3 = 0 then
  case when ownership = 'PROVIDER_OWNED' then 'IN_STOCK' else 'ON_ORDER' end else status end
  as status, case when status <> 'RETIRED' and engagement_id % 3 = 0 then null
  else engagement_id end as engagement_id from vehicles""")
def batch_assign_release(spark, d):
    units = views.vehicles(spark, d)
    gone = units.filter("engagement_id % 3 = 0 and status <> 'RETIRED'").select("vehicle_id")
    return fleet.release(units, gone).select("vehicle_id", "status", "engagement_id")


@query("J24_assigned_vehicles", uses="vehicles engagements", sql="""
with rq as (select vehicle_id, coalesce(engagement_id, cast(split_part(vehicle_id, '-', 1) as
   bigint)) + case when substr(vehicle_id, length(vehicle_id), 1) = '3' then 1 else 0 end as t
  from vehicles),
 ok as (select rq.vehicle_id, t from rq join vehicles v on v.vehicle_id = rq.vehicle_id
  join engagements e on e.engagement_id = t where not (coalesce(v.engagement_id <> t, false)
   or v.status = 'RETIRED' or (ownership = 'CUSTOMER_OWNED' and
   coalesce(owner_customer_id <> e.customer_id, false))))
select v.vehicle_id, case when t is not null then 'ASSIGNED' else status end as status,
  coalesce(t, engagement_id) as engagement_id, t is not null as in_history
from vehicles v left join ok on ok.vehicle_id = v.vehicle_id""")
def assigned_vehicles(spark, d):
    """Vehicles after a batch of assignments, and which of them got a history row."""
    units, history = fleet.assign(views.vehicles(spark, d), decided_assignments(spark, d),
                                  views.as_of())
    logged = history.select("vehicle_id", F.lit(True).alias("in_history"))
    return (units.join(logged, "vehicle_id", "left")
            .select("vehicle_id", "status", "engagement_id",
                    F.coalesce("in_history", F.lit(False)).alias("in_history")))


@query("J24_assignment_outcome", uses="vehicles engagements", sql="""
with rq as (select vehicle_id, coalesce(engagement_id, cast(split_part(vehicle_id, '-', 1) as
   bigint)) + case when substr(vehicle_id, length(vehicle_id), 1) = '3' then 1 else 0 end as t
  from vehicles)
select t as target_engagement, count(*) filter (where ok) as accepted,
 count(*) filter (where not ok) as failed from (select t, coalesce(not (e.engagement_id is null
  or coalesce(v.engagement_id <> t, false) or v.status = 'RETIRED' or (ownership =
  'CUSTOMER_OWNED' and owner_customer_id <> e.customer_id)), false) as ok
 from rq join vehicles v on v.vehicle_id = rq.vehicle_id left join engagements e
 on e.engagement_id = t) group by t""")
def assignment_outcome(spark, d):
    return decided_assignments(spark, d).groupBy("target_engagement").agg(
        F.count_if(F.col("refused").isNull()).alias("accepted"),
        F.count_if(F.col("refused").isNotNull()).alias("failed"))
