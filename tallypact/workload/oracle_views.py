"""Domain views for the checking SQL, written apart from the Spark views they check."""

from tallypact import fixed_values as fv

AS_OF = "DATE '2000-06-30'"


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def case_of(column: str, mapping: dict, default: str = "null") -> str:
    arms = " ".join(
        f"when {column} = '{k}' then '{v}'" if isinstance(k, str) else
        f"when {column} = {k} then '{v}'" for k, v in mapping.items())
    return f"case {arms} else {default} end"


LINE_ID = "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)"

_RULES = " ".join(
    f"when regexp_matches(t, '{p}', 'i') then '{b}|{c}'" for p, b, c in fv.FREQUENCY_RULES)


def frequency_case(text: str) -> str:
    """'basis|class' of a wording; the first rule that matches wins."""
    return ("case when coalesce(trim(" + text + "), '') = '' then 'other|usage' "
            + _RULES.replace("regexp_matches(t,", f"regexp_matches({text},") +
            " else 'other|usage' end")


def stage_case(col: str) -> str:
    arms = " ".join(f"when {col} in ({quoted(v[1])}) then '{k}'" for k, v in fv.STAGES.items())
    return f"case {arms} else 'NEGOTIATIONS' end"


VIEWS = {
    "customers": """select c_custkey as customer_id, c_name as legal_name,
        c_mktsegment as industry, n_name as country,
        case when c_acctbal < 0 then 'INACTIVE' else 'ACTIVE' end as status
        from customer join nation on c_nationkey = n_nationkey""",
    "engagements": """select o_orderkey as engagement_id, o_custkey as customer_id,
        c_name as client_name, cast(o_orderdate as date) as created_at,
        case when o_orderstatus='F' then 'ACTIVE'
         when o_orderstatus='O' then case o_orderpriority
          when '1-URGENT' then 'PENDING_CLIENT_APPROVAL' when '2-HIGH' then
          'CHANGES_REQUESTED_CLIENT' when '3-MEDIUM' then 'CLIENT_APPROVED'
          when '4-NOT SPECIFIED' then 'BILLING_SETUP' else 'PENDING_BILLING_AUDIT' end
         else case o_orderpriority when '1-URGENT' then 'DRAFT' when '2-HIGH' then 'EXTRACTING'
          when '3-MEDIUM' then 'IN_UNDERWRITING' when '4-NOT SPECIFIED' then 'REVALIDATING'
          else 'VALIDATION_FAILED' end end as status,
        case o_orderkey % 3 when 0 then 'monthly' when 1 then 'quarterly' else 'annual' end
         as billing_frequency,
        cast(o_orderdate as date) as billing_start,
        cast(12 * (1 + o_orderkey % 5) as int) as contract_term_months,
        case when o_orderkey % 4 = 0 then null else cast(floor(o_totalprice / 5000) as int) end
         as fleet_size_override
        from orders join customer on o_custkey = c_custkey""",
    "submissions": """select o_custkey as engagement_id, o_orderkey as submission_id,
        cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as int)
         as cycle, cast(o_orderdate as date) as created_at,
        case o_orderstatus when 'F' then 'ACTIVE' when 'O' then 'PENDING_CLIENT_APPROVAL'
         else 'DRAFT' end as status from orders""",
    "review_cycles": f"""select l_orderkey as engagement_id, {LINE_ID} as submission_id,
        cast(l_linenumber as int) as cycle, cast(l_shipdate as date) as created_at,
        case l_returnflag when 'A' then 'ACTIVE' when 'N' then 'PENDING_CLIENT_APPROVAL'
         else 'DRAFT' end as status from lineitem""",
    "pricing_terms": f"""select l_orderkey as engagement_id, l_orderkey as document_id,
        cast(1 + l_suppkey % 2 as int) as version, concat(p_name, ' Program') as program,
        p_brand as item,
        case l_linenumber when 1 then 'pvpm' when 2 then 'per vehicle per month'
         when 3 then 'per driver per month' when 4 then 'per card' when 5 then 'per claim'
         when 6 then 'one-time' else 'rebate per litre' end as frequency,
        cast(l_discount * 100 as decimal(18,2)) as amount,
        cast(l_tax * 100 as decimal(18,2)) as rate_pct,
        cast(1 - l_tax * 3 as decimal(4,2)) as confidence, l_returnflag = 'A' as approved,
        l_returnflag = 'R' as superseded, {LINE_ID} as term_key, l_linenumber, l_suppkey,
        l_partkey, l_quantity
        from lineitem join part on l_partkey = p_partkey""",
    "programs": "select distinct p_name as name from part",
    "raw_names": f"""select l_orderkey as engagement_id,
        case l_suppkey % 5 when 0 then p_name
         when 1 then concat(upper(p_name), ' PROGRAM (SECTION 2)')
         when 2 then concat(p_name, ' Services')
         when 3 then concat(substr(p_name, 1, length(p_name) - 2),
                            substr(p_name, length(p_name), 1))
         else concat('unlisted ', p_type) end as raw, p_brand as item_raw,
        {LINE_ID} as term_key, l_shipdate
        from lineitem join part on l_partkey = p_partkey""",
    "vehicles": f"""select {LINE_ID} as vehicle_id,
        case when l_suppkey % 4 = 0 then 'CUSTOMER_OWNED' else 'PROVIDER_OWNED' end as ownership,
        case when l_returnflag = 'R' then 'RETIRED' when l_linestatus = 'O' then 'ASSIGNED'
         when l_returnflag = 'A' then 'IN_STOCK' else 'IN_MAINTENANCE' end as status,
        {case_of('l_partkey % 14', dict(enumerate(fv.BODY_CLASSES)))} as body_class,
        case l_linenumber % 4 when 0 then 'ICE' when 1 then 'HYBRID' when 2 then 'PHEV'
         else 'BEV' end as powertrain,
        case when l_linestatus = 'O' then l_orderkey end as engagement_id,
        case when l_suppkey % 4 = 0 then 1 + l_partkey % 1000 end as owner_customer_id,
        cast(l_shipdate as date) as assigned_at
        from lineitem""",
    "audit_events": """select event_id, ts, user_id as submission_id,
        case event_id % 12 when 0 then 'submit_for_processing' when 1 then 'pipeline_done'
         when 2 then 'submit_to_client' when 3 then 'client_approve'
         when 4 then 'client_request_changes' when 5 then 'reupload'
         when 6 then 'resubmit_to_client' when 7 then 'sanity_pass' when 8 then 'sanity_fail'
         when 9 then 'capture_fields' when 10 then 'billing_ready' else 'approve_billing' end
         as action,
        case event_type when 'error' then 'system' when 'click' then 'client'
         when 'view' then 'provider' when 'purchase' then 'finance' else 'provider' end
         as actor_role, props as comment from events""",
    "memberships": """select event_id as engagement_id, user_id,
        case event_type when 'view' then 'provider' when 'purchase' then 'finance'
         else 'client' end as role,
        concat('user', user_id, '@example.com') as email,
        case when event_id % 3 = 0 then concat('Person ', user_id) end as name,
        case when event_id % 5 = 0 then
         concat('555-', lpad(substr(cast(user_id as varchar), 1, 4), 4, '0')) end as phone
        from events""",
    "provider_directory": """select s_suppkey as user_id,
        concat('staff', s_suppkey, '@example.com') as email, s_name as name from supplier""",
    "agreements": """select doc_id as document_id, doc_id // 20 as engagement_id,
        concat(case doc_id % 5
         when 0 then 'MASTER LEASE AGREEMENT effective as of January 5, 2024. '
         when 1 then 'Master Services Agreement dated as of 3 March 2022. '
         when 2 then 'STATEMENT OF WORK Effective Date: 2021-07-01. '
         when 3 then 'Master Service Agreement effective as of February 30, 2024; see master lease agreement. '
         else '' end, text) as full_text, doc_id as created_ord from documents""",
    "quotes": "select item_id as quote_id, text as quote from benchmark",
    "calls": """select conv_id as run_id, turn as call_no,
        case conv_id % 4 when 0 then 'global.anthropic.claude-sonnet-4-6'
         when 1 then 'global.amazon.nova-2-lite-v1:0' when 2 then 'apac.amazon.nova-lite-v1:0'
         else 'unknown-model' end as model,
        cast(length(text) as bigint) as input_tokens,
        cast(floor(length(text) / 4) as bigint) as output_tokens,
        cast(length(text) * 2 as bigint) as cache_read_tokens,
        cast(floor(length(text) / 2) as bigint) as cache_write_tokens,
        case when role = 'user' then 'tool_use' else 'max_tokens' end as stop_reason
        from conversations""",
}

# --- views built on views --------------------------------------------------------------------
VIEWS["priced_terms"] = f"""select *,
    split_part({frequency_case('frequency')}, '|', 1) as unit_basis,
    split_part({frequency_case('frequency')}, '|', 2) as billing_class from pricing_terms"""

VIEWS["fleet_sizes"] = """select e.engagement_id,
    cast(case when fleet_size_override is not null then greatest(1, fleet_size_override)
         else coalesce(n, 0) end as bigint) as fleet_size
    from engagements e left join (select engagement_id as eid, count(*) as n from vehicles
      where engagement_id is not null group by engagement_id) v on e.engagement_id = v.eid"""

VIEWS["dues"] = """select f.engagement_id, f.fleet_size,
    cast(coalesce(per_unit, 0) * f.fleet_size as decimal(18,2)) as monthly_recurring
    from fleet_sizes f left join (
      select engagement_id as eid, sum(case when regexp_matches(unit_basis,
        'per_(vehicle|unit).*month') then amount else 0 end) as per_unit
      from priced_terms where not superseded group by engagement_id) t
    on f.engagement_id = t.eid"""

VIEWS["payments"] = f"""select e.engagement_id, cast(i as int) as seq,
    case when i = 0 then 'initial' else 'recurring' end as kind,
    cast(e.billing_start + to_months(cast(i * m as int)) as date) as due_date,
    (cast(e.billing_start + to_months(cast(i * m as int)) as date) <= {AS_OF}
      and (e.engagement_id + i) % 5 <> 0) as paid,
    case when cast(e.billing_start + to_months(cast(i * m as int)) as date) <= {AS_OF}
      and (e.engagement_id + i) % 5 <> 0 then cast(monthly_recurring * m as decimal(18,2)) end
      as amount_paid,
    m as months, cast(monthly_recurring * m as decimal(18,2)) as period_amount
    from engagements e join dues d on e.engagement_id = d.engagement_id,
    lateral (select case billing_frequency when 'monthly' then 1 when 'quarterly' then 3 else 12
      end as m, case billing_frequency when 'monthly' then 12 when 'quarterly' then 4 else 3 end
      as cnt) c, lateral (select unnest(range(cnt)) as i) r"""

VIEWS["schedule"] = f"""select *, case when paid then amount_paid else period_amount end as amount,
    case when paid then 'paid' when {AS_OF} < due_date then 'upcoming'
     when {AS_OF} < coalesce(lead(due_date) over (partition by engagement_id order by seq),
       cast(due_date + to_months(cast(months as int)) as date)) then 'due' else 'overdue' end
     as status,
    min(case when not paid and due_date > {AS_OF} then seq end)
      over (partition by engagement_id) as next_early
    from payments"""

VIEWS["cycle_in_force"] = """select * from (select *, row_number() over (partition by
    engagement_id order by case when status = 'ACTIVE' then 1 else 0 end desc, cycle desc,
    created_at desc, submission_id desc) as rn from review_cycles) where rn = 1"""

VIEWS["portfolio"] = f"""select e.engagement_id, e.customer_id, c.legal_name as customer_name,
    coalesce(s.status, e.status) as status, e.created_at, d.fleet_size, d.monthly_recurring,
    cast(e.created_at + to_months(e.contract_term_months) as date) as contract_end,
    date_diff('day', {AS_OF}, cast(e.created_at + to_months(e.contract_term_months) as date))
      as days_to_expiry,
    coalesce(paid_amount, 0) as collected_amount, coalesce(paid_count, 0) as collected_count,
    coalesce(outstanding, 0) as outstanding_amount, coalesce(overdue_count, 0) as overdue_count,
    coalesce(overdue_amount, 0) as overdue_amount
    from engagements e join dues d on e.engagement_id = d.engagement_id
    left join cycle_in_force s on e.engagement_id = s.engagement_id
    left join customers c on e.customer_id = c.customer_id
    left join (select engagement_id as eid,
      sum(case when status = 'paid' then amount else 0 end) as paid_amount,
      count(*) filter (where status = 'paid') as paid_count,
      sum(case when status in ('due', 'overdue') then amount else 0 end) as outstanding,
      count(*) filter (where status = 'overdue') as overdue_count,
      sum(case when status = 'overdue' then amount else 0 end) as overdue_amount
      from schedule group by engagement_id) p on e.engagement_id = p.eid"""

PORTFOLIO = ("customers engagements vehicles pricing_terms priced_terms fleet_sizes dues payments "
             "schedule review_cycles cycle_in_force portfolio")
SCHEDULE = "engagements vehicles pricing_terms priced_terms fleet_sizes dues payments schedule"

_KIND = """case l_partkey % 12 when 4 then 'sla_item' when 5 then 'reporting_requirement'
  when 6 then 'definition' when 7 then 'online_tool' when 8 then 'responsibility'
  when 9 then 'signature' when 10 then 'information_section' when 11 then 'uncategorised'
  else 'pricing_item' end"""
VIEWS["records"] = f"""select ordinal, l_orderkey as engagement_id, l_orderkey as document_id,
  cast(1 + l_suppkey % 2 as int) as version, k as info_type,
  case when k = 'pricing_item' then concat(p_name, ' Program') end as program,
  case when k = 'pricing_item' and l_suppkey % 4 <> 0 then p_brand
   when k = 'uncategorised' then p_type end as item,
  cast(null as varchar) as sub_category,
  case when k = 'pricing_item' then case l_linenumber when 1 then 'pvpm'
    when 2 then 'per vehicle per month' when 3 then 'per driver per month' when 4 then 'per card'
    when 5 then 'per claim' when 6 then 'one-time' else 'rebate per litre' end
   when k = 'reporting_requirement' then 'Monthly' end as frequency,
  case when k = 'pricing_item' and l_suppkey % 5 <> 0
   then cast(l_discount * 100 as decimal(18,2)) end as amount,
  case when k = 'pricing_item' and l_suppkey % 7 = 0 then 'ten percent of charges' end
   as calculation,
  case when k = 'pricing_item' then l_suppkey % 11 = 0 end as included,
  case when k = 'pricing_item' then cast(l_tax * 100 as decimal(18,2)) end as rate_pct,
  case when k = 'sla_item' then p_name end as category,
  case when k = 'sla_item' then p_brand end as contract_sub_section,
  case when k = 'reporting_requirement' then concat(p_name, ' Report') end as report_name,
  case when k = 'definition' then p_name end as term,
  case when k = 'definition' then p_type end as definition,
  case when k = 'online_tool' then p_name end as tool_name,
  case when k = 'online_tool' then p_brand end as platform,
  case when k in ('responsibility', 'information_section') then p_brand end as topic,
  case when k = 'responsibility' then p_name end as task,
  case when k = 'responsibility' then 'Vendor' end as responsible_party,
  case when k = 'signature' then concat('Company ', l_suppkey % 10) end as company,
  case when k = 'signature' then p_name end as name,
  case when k = 'information_section' then p_type end as description,
  cast(1 - l_tax * 3 as decimal(4,2)) as confidence,
  case when l_partkey % 13 <> 0 then p_type end as quote,
  case when k = 'pricing_item' then case l_suppkey % 6 when 0 then 'fuzzy' when 1 then 'unmatched'
   else 'exact' end end as catalog_match,
  case when l_suppkey % 8 = 0 then 'see schedule' end as notes,
  l_returnflag = 'A' as approved, l_returnflag = 'R' as superseded
  from (select *, {LINE_ID} as ordinal, {_KIND} as k from lineitem join part
        on l_partkey = p_partkey)"""


def sql_stream(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9$%/-]', '', 'g')"


_PRICING_IDS = "concat_ws('|', " + ", ".join(
    sql_stream(f) for f in fv.IDENTITY_FIELDS["pricing_item"]) + ")"
_IDS = " ".join(
    f"when '{k}' then concat_ws('|', {', '.join(sql_stream(f) for f in v)})"
    for k, v in fv.IDENTITY_FIELDS.items())
SQL_RECORD_ID = f"""substr(sha1(concat_ws('|', info_type, case info_type {_IDS} else '' end,
  case when info_type = 'pricing_item' then concat_ws('|', coalesce(cast(cast(amount as
   decimal(18,2)) as varchar), 'None'), case when included then 'True' else 'False' end) end)),
  1, 16)"""
SQL_LINE_KEY = "concat_ws('|', " + ", ".join(
    sql_stream(f) for f in fv.IDENTITY_FIELDS["pricing_item"]) + ")"
SQL_PRICING_ID = f"""substr(sha1(concat_ws('|', info_type, {_PRICING_IDS}, coalesce(cast(cast(
  amount as decimal(18,2)) as varchar), 'None'), case when included then 'True' else 'False' end)),
  1, 16)"""

OUTBOX_SQL = f"""
select a.event_id, a.submission_id as engagement_id, template, user_id, email
from audit_events a join (values {", ".join(
    f"('{a}', '{t}', '{r}')" for a, sends in fv.NOTIFICATION_ROUTES.items()
    for t, roles in sends for r in roles)}) v(act, template, r) on act = action
join memberships m on m.engagement_id = a.submission_id and m.role = r"""

#: Events that arrive in three parts, each in order of time after the parts before.
LATE_REPLAY_SQL = f"""
with recursive ev as (select *, row_number() over (partition by submission_id order by event_id % 3, ts, event_id) as rn
  from ({VIEWS["audit_events"]})),
 walk as (select submission_id, 0::bigint as rn, null::bigint as event_id, null::varchar as status_before,
   'DRAFT' as status_after from (select distinct submission_id from ev)
  union all select e.submission_id, e.rn, e.event_id, w.status_after, coalesce(t.target, w.status_after)
  from walk w join ev e on e.submission_id = w.submission_id and e.rn = w.rn + 1
  left join transitions t on t.source = w.status_after and t.act = e.action and t.role = e.actor_role)
select submission_id, event_id, status_before, exists(select 1 from transitions t, ev e where e.event_id = w.event_id
  and t.source = status_before and t.act = e.action and t.role = e.actor_role) as accepted, status_after
from walk w where rn > 0"""
