"""Non-productive-time questions and the confirmation workflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from tourlog.functions import scalars as S
from tourlog.operators import lookups as L
from tourlog.operators import npt as N
from tourlog.operators import ordering
from tourlog.plans.registry import cte, derived_view, query, view

derived_view(
    "translation_content",
    """
select record_id, concat(record_id, ':operations:', cast(row_no as string)) as entity_id,
  'operations' as entity_type, 'operations.operation_details' as field_code, 'es' as source_language,
  case when l_suppkey % 31 = 0 then 'en' else 'zh-CN' end as target_language,
  case l_partkey % 5 when 2 then concat(operation_details, ' old') when 3 then replace(operation_details, ' ', '  ')
    else operation_details end as source_text,
  case l_partkey % 5 when 2 then sha256(record_id) when 3 then sha256(record_id) else sha256(operation_details) end
    as source_hash,
  case when l_suppkey % 11 = 0 then ' ' else concat('译 ', operation_details) end as translated_text,
  case when l_suppkey % 13 = 0 then 'FAILED' when l_suppkey % 14 = 0 then 'NOT_REQUIRED' else 'COMPLETED' end
    as translation_status,
  case when l_suppkey % 13 = 0 then concat('error ', cast(l_partkey % 3 as string)) else '' end as error_message,
  case when l_partkey % 8 = 0 then 'yes' else '' end as is_manual_modified,
  case when l_partkey % 2 = 0 then 'v1' else 'v2' end as prompt_version,
  concat('2001-01-', lpad(cast(1 + l_partkey % 28 as string), 2, '0')) as updated_at,
  concat('2000-01-', lpad(cast(1 + l_suppkey % 28 as string), 2, '0')) as created_at,
  l_partkey, l_suppkey, row_no, operation_details
from operations
where l_tax < 0.07
""",
    "operations",
    spark_names={"operations": "numbered_operations"},
)

derived_view(
    "extraction_results",
    """
select record_id, 'rule-line' as rule_id, 'operations' as source_section, row_no as source_row_no,
  'operation_details' as source_field, 'service_line' as target_field,
  case l_partkey % 4 when 1 then sha256(record_id) else sha256(operation_details) end as source_hash,
  concat(' LINE ', cast(l_suppkey % 9 as string), ' ') as result_text,
  case when l_suppkey % 10 = 0 then '' when l_suppkey % 10 = 1 then 'FAILED' else 'COMPLETED' end as extraction_status,
  case when l_suppkey % 10 = 1 then concat('fail ', cast(l_partkey % 4 as string)) else '' end as error_message,
  case when l_partkey % 4 = 2 then 'rules-v1' else 'rules-v2' end as rule_version,
  cast(l_partkey % 3 as int) as attempt_count, '2001-02-01' as updated_at
from operations
where l_discount > 0.02
""",
    "operations",
    spark_names={"operations": "numbered_operations"},
)

VERSION = "rules-v2"


@view("fact_operations")
def fact_operations_view(i):
    own = F.when(F.col("l_suppkey") % 23 == 0, "OWN CO").otherwise("")
    ops = i.v("numbered_operations").withColumn("service_line", own)
    return L.fact_operations(i.v("facts"), ops, i.v("translation_content"), i.v("extraction_results"), VERSION)


cte(
    "fact_operations",
    """
select f.record_id, f.report_type, f.report_date, left(f.report_date, 7) as month, f.wellbore, f.rig, f.project_id,
  f.project_name, f.project_contract, f.validation_status, f.event, o.row_no, o.h as hours, o.eff_type as op_type,
  o.op_code, o.op_sub, o.reason, o.from_time || ' - ' || o.to_time as time_range, o.operation_details,
  case when t.good then trim(t.translated_text) else '' end as translated,
  case when t.good then 'COMPLETED' else coalesce(t.translation_status, 'MISSING') end as translation_status,
  case when o.eff_type = 'NPT' and e.same then trim(e.result_text)
    when o.l_suppkey % 23 = 0 then 'OWN CO' else '' end as service_line,
  case when o.eff_type <> 'NPT' then 'NOT_REQUIRED' when e.record_id is null then 'PENDING' when not e.same then 'STALE'
    when e.extraction_status = 'COMPLETED' and e.rule_version <> 'rules-v2' then 'STALE'
    when e.extraction_status = '' then 'PENDING' else e.extraction_status end as extraction_status
from facts f join operations o on o.record_id = f.record_id
left join (select *, l_partkey % 5 <> 2 and translation_status = 'COMPLETED' and trim(translated_text) <> '' as good
  from translation_content where target_language = 'zh-CN') t on t.record_id = o.record_id and t.row_no = o.row_no
left join (select *, source_hash <> sha256(record_id) as same from extraction_results) e
  on e.record_id = o.record_id and e.source_row_no = o.row_no
""",
    "facts",
    "operations",
    "translation_content",
    "extraction_results",
)


@query("fact_operations", "select * from fact_operations", uses=("fact_operations",))
def fact_operations(i):
    return i.v("fact_operations")


@query(
    "operation_translation_lookup",
    """select record_id, row_no, project_id, translated, translation_status from fact_operations""",
    uses=("fact_operations",),
)
def operation_translation_lookup(i):
    return i.v("fact_operations").select("record_id", "row_no", "project_id", "translated", "translation_status")


@query(
    "operation_extraction_lookup",
    """select extraction_status, service_line, count(*) as n from fact_operations group by 1, 2""",
    uses=("fact_operations",),
)
def operation_extraction_lookup(i):
    return i.v("fact_operations").groupBy("extraction_status", "service_line").agg(F.count(F.lit(1)).alias("n"))


def _npt_facts(i):
    """Report-level NPT rows: enough for every panel that does not ask for a reason."""
    return i.v("facts").filter("n_npt > 0").withColumn("hours", F.col("npt_h"))


@query(
    "npt_kpis",
    """
select count(distinct nullif(rig, '')) as rig_count, count(distinct nullif(wellbore, '')) as well_count,
  sum(n_npt)::bigint as event_count, sum(npt_h) as total_npt from facts where n_npt > 0
""",
    uses=("facts",),
)
def npt_kpis(i):
    folded = _npt_facts(i).groupBy("rig", "wellbore").agg(F.sum("n_npt").alias("n"), F.sum("hours").alias("hours"))
    return folded.agg(
        F.countDistinct(F.nullif(F.col("rig"), F.lit(""))).alias("rig_count"),
        F.countDistinct(F.nullif(F.col("wellbore"), F.lit(""))).alias("well_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("event_count"),
        F.coalesce(F.sum("hours"), F.lit(0.0)).alias("total_npt"),
    )


for _name, _key in (("npt_by_rig_sum", "rig"), ("npt_by_month", "left(report_date, 7)")):

    @query(
        _name,
        f"""select case when {_key} = '' then '未识别' else {_key} end as label, sum(npt_h) as hours from facts
where n_npt > 0 group by 1""",
        uses=("facts",),
    )
    def npt_sum(i, key=_key):
        return N.sum_hours(_npt_facts(i), F.expr(key))


@query(
    "npt_by_well_top10",
    """select case when wellbore = '' then '未识别' else wellbore end as label, sum(npt_h) as hours from facts
where n_npt > 0 group by 1 order by hours desc, label limit 10""",
    uses=("facts",),
)
def npt_by_well_top10(i):
    return N.sum_hours(_npt_facts(i), F.col("wellbore")).limit(10)


@query(
    "npt_by_reason",
    """
select reason as label, sum(hours) as hours, sum(hours) / (select sum(hours) from fact_operations where op_type = 'NPT') * 100 as share
from fact_operations where op_type = 'NPT' group by reason
""",
    uses=("fact_operations",),
)
def npt_by_reason(i):
    reasons = N.npt_by_reason_per_record(i.v("operations"))
    rows = i.v("facts").select("record_id").join(reasons, "record_id")
    total = _npt_facts(i).agg(F.sum("hours").alias("hours"))
    return N.with_share(N.sum_hours(rows, F.col("reason")), total)


@query(
    "npt_wells",
    """
select rig, wellbore, min(report_date) as start_date, max(report_date) as end_date,
  case when count(*) filter (locked = 'yes') = count(*) then 'confirmed'
    when bool_or(confirmation_status in ('draft', 'confirmed')) then 'draft' else 'pending' end as status,
  count(*) as record_count, sum(n)::bigint as row_count, sum(sc) as sc_hours, sum(npt) as npt_hours
from records r join (
  select record_id, count(*) as n, sum(case when sys_type = 'SC' then h else 0.0 end) as sc,
    sum(case when sys_type = 'NPT' then h else 0.0 end) as npt
  from operations group by record_id having bool_or(sys_type in ('SC', 'NPT'))) o on o.record_id = r.record_id
where wellbore <> '' group by rig, wellbore
""",
    uses=("records", "operations"),
)
def npt_wells(i):
    return N.confirmation_wells(i.v("records"), N.system_hours(i.v("operations")))


@query(
    "npt_confirmation_meta",
    """
select wellbore, min(report_date) as start_date, max(report_date) as end_date,
  case when count(*) filter (locked = 'yes') = count(*) then 'confirmed'
    when bool_or(confirmation_status in ('draft', 'confirmed')) then 'draft' else 'pending' end as status,
  count(*) as record_count, bool_and(locked = 'yes') as locked,
  coalesce(max_by(confirmation_note, struct_pack(a := report_date, b := updated_at, c := rk))
    filter (confirmation_note <> ''), '') as confirmation_note
from records where record_id in (select record_id from operations where sys_type in ('SC', 'NPT')) group by wellbore
""",
    uses=("records", "operations"),
)
def npt_confirmation_meta(i):
    return N.confirmation_meta(i.v("records"), N.system_hours(i.v("operations")))


@query(
    "npt_candidates",
    """
select r.record_id, r.rig, r.wellbore, coalesce(o.op_code, '') as op_code, coalesce(o.h, 0.0) as hours
from records r left join operations o on o.record_id = r.record_id
where r.rig = 'ACME 103' and lower(r.wellbore) like '%w-01%'
""",
    uses=("records", "operations"),
)
def npt_candidates(i):
    rows = N.candidates(i.v("records"), i.v("operations"), rig="ACME 103", wellbore="W-01", scope_rig="ACME 103")
    return rows.select(
        "record_id", "rig", "wellbore", F.coalesce("op_code", F.lit("")).alias("op_code"),
        F.coalesce("h", F.lit(0.0)).alias("hours"),
    )


_NPT_ROWS = """
select wellbore, rig, project_name, report_date, time_range, hours, case when service_line = '' then '-' else service_line end
  as service_line, extraction_status, case when op_sub <> '' then op_sub when op_code <> '' then op_code else reason end
  as npt_keyword, operation_details
from fact_operations where op_type = 'NPT'
"""


@query(
    "default_npt_sort",
    "select record_id, row_no, project_id, wellbore, report_date, rig from fact_operations where op_type = 'NPT'",
    uses=("fact_operations",),
)
def default_npt_sort(i):
    rows = i.v("fact_operations").filter("op_type = 'NPT'")
    rows = rows.withColumn("contract_project", S.contract_label(F.col("project_contract"), F.col("project_name")))
    return N.default_order(rows).select("record_id", "row_no", "project_id", "wellbore", "report_date", "rig")


@query(
    "dump_npt_report",
    f"select case when wellbore = '' then '-' else wellbore end as wellbore, case when rig = '' then '-' else rig end as rig, "
    f"case when project_name = '' then '-' else project_name end as project_name, * exclude (wellbore, rig, project_name) "
    f"from ({_NPT_ROWS})",
    uses=("fact_operations",),
)
def dump_npt_report(i):
    from tourlog.sources.sinks import npt_export

    rows = i.v("fact_operations").filter("op_type = 'NPT'")
    # the label of a row without contract or project is '-', which the export keeps
    rows = rows.withColumn("contract_project", S.contract_label(F.col("project_contract"), F.col("project_name")))
    return npt_export(rows, show_rig=True)


# --- confirmation merge ----------------------------------------------------------------


def _confirm(i, submit: bool):
    records = i.v("records").withColumn("batch", F.concat_ws("|", "wellbore", "report_date"))
    ops = i.v("numbered_operations")
    proposed = F.when(F.col("l_suppkey") % 8 == 0, "x").when(F.col("l_suppkey") % 2 == 0, "sc ").otherwise("NPT")
    edits = ops.select(
        "record_id", "row_no", proposed.alias("type"),
        F.when(F.col("l_partkey") % 150 == 0, "stale").otherwise(N.revision()).alias("row_revision"),
    )
    return N.confirm(records, ops, edits, submit, "checked", "kim", "2001-07-01T00:00:00")


_CONFIRM = """
with_batch as (select *, wellbore || '|' || report_date as batch from records),
rel as (select * from with_batch where record_id in (select record_id from operations where sys_type in ('SC', 'NPT'))),
ed as (select o.record_id, o.row_no, batch, case when l_suppkey % 2 = 0 then 'SC' else 'NPT' end as new_type, l_partkey % 150 = 0 as stale
  from operations o join rel on rel.record_id = o.record_id where l_suppkey % 8 <> 0),
outcomes as (
  select a.batch, case when w.batch is null then 'not_found' when all_locked then 'locked' when e.batch is null then 'no_valid_rows'
    when any_locked then 'locked' when stale then 'changed' else '{ok}' end as outcome
  from (select distinct batch from with_batch join operations using (record_id)) a
  left join (select batch, bool_or(locked = 'yes') as any_locked, bool_and(locked = 'yes') as all_locked from rel group by batch) w
    on w.batch = a.batch
  left join (select batch, bool_or(stale) as stale from ed group by batch) e on e.batch = a.batch)
"""


@query(
    "npt_confirm",
    "," + _CONFIRM.format(ok="confirmed") + """
select o.record_id, o.row_no, case when n.new_type is null then o.op_type else n.new_type end as op_type,
  case when n.new_type is null then o.confirmed_op_type else n.new_type end as confirmed_op_type,
  case when n.new_type is null then o.draft_op_type else '' end as draft_op_type,
  case when n.new_type is null or o.system_op_type <> '' then o.system_op_type else o.op_type end as system_op_type
from operations o left join (select ed.* from ed join outcomes using (batch) where outcome = 'confirmed') n
  on n.record_id = o.record_id and n.row_no = o.row_no
""",
    uses=("records", "operations"),
)
def npt_confirm(i):
    _, ops, _ = _confirm(i, submit=True)
    return ops.select("record_id", "row_no", "op_type", "confirmed_op_type", "draft_op_type", "system_op_type")


@query(
    "npt_confirm_outcomes",
    "," + _CONFIRM.format(ok="draft") + "select batch, outcome from outcomes",
    uses=("records", "operations"),
)
def npt_confirm_outcomes(i):
    outcomes, _, _ = _confirm(i, submit=False)
    return outcomes


@query(
    "npt_confirm_records",
    "," + _CONFIRM.format(ok="confirmed") + """
select r.record_id, case when h.batch is null then r.locked else 'yes' end as locked,
  case when h.batch is null then r.confirmation_status else 'confirmed' end as confirmation_status,
  case when h.batch is null then r.confirmation_note else 'checked' end as confirmation_note,
  case when h.batch is null then r.updated_at else '2001-07-01T00:00:00' end as updated_at,
  case when h.batch is null then '' else 'kim' end as confirmed_by
from records r left join (select rel.record_id, batch from rel join outcomes using (batch) where outcome = 'confirmed') h
  on h.record_id = r.record_id
""",
    uses=("records", "operations"),
)
def npt_confirm_records(i):
    _, _, records = _confirm(i, submit=True)
    return records.select("record_id", "locked", "confirmation_status", "confirmation_note", "updated_at", "confirmed_by")


@query(
    "adjacent_context",
    """
select record_id, row_no, left(coalesce(lag(trim(operation_details)) over w, ''), 600) as previous_event,
  left(coalesce(lead(trim(operation_details)) over w, ''), 600) as next_event
from operations window w as (partition by record_id order by row_no)
""",
    uses=("operations",),
)
def adjacent_context(i):
    rows = i.v("numbered_operations").select(
        "record_id", "row_no", F.substring(S.squeeze(F.col("operation_details")), 1, 600).alias("event")
    )
    near = ordering.neighbours(
        rows, ["record_id"], "row_no", {"previous_event": ("event", -1), "next_event": ("event", 1)}
    )
    return near.na.fill("", ["previous_event", "next_event"]).drop("event")


@query("row_number_assign", "select record_id, row_no, l_partkey from operations", uses=("operations",))
def row_number_assign(i):
    return i.v("numbered_operations").select("record_id", "row_no", "l_partkey")


@query(
    "calendar_operation_days",
    """
select wellbore, report_date, p, sc, npt, case when p + sc + npt = 0 then 0.0 else p / (p + sc + npt) end as p_share,
  case when p + sc + npt = 0 then 0.0 else sc / (p + sc + npt) end as sc_share,
  case when p + sc + npt = 0 then 0.0 else npt / (p + sc + npt) end as npt_share
from (select wellbore, report_date, sum(greatest(0.0, coalesce(p_h, 0.0))) as p, sum(greatest(0.0, coalesce(sc_h, 0.0))) as sc,
  sum(greatest(0.0, coalesce(npt_h, 0.0))) as npt
  from records r left join record_hours h on h.record_id = r.record_id group by wellbore, report_date)
""",
    uses=("records", "record_hours"),
)
def calendar_operation_days(i):
    from tourlog.operators.wells import calendar_days

    return calendar_days(i.v("records").join(i.v("record_hours"), "record_id", "left"))


@query(
    "stage_days",
    """
select wellbore, count(distinct case when lower(event) like '%rig move%' then report_date end) as move_days,
  count(distinct case when lower(event) not like '%rig move%' and lower(event) like '%drilling%' then report_date end)
    as drilling_days
from records where report_type = 'drilling' and report_date <> '' group by wellbore
""",
    uses=("records",),
)
def stage_days(i):
    from tourlog.operators.wells import stage_days

    return stage_days(i.v("records"))


@query(
    "well_list",
    """
select wellbore, count(distinct report_date) as days, min(report_date) as first_date, max(report_date) as last_date,
  bool_or(coalesce(npt_h, 0.0) > 0) as has_npt
from records r left join record_hours h on h.record_id = r.record_id where wellbore <> '' group by wellbore
""",
    uses=("records", "record_hours"),
)
def well_list(i):
    from tourlog.operators.wells import well_list

    return well_list(i.v("records").join(i.v("record_hours"), "record_id", "left"), sort_by="last")


@query(
    "hour_shares",
    """
select wellbore, case when t > 0 then floor(p / t * 100 + 0.5)::bigint else 0 end as p_share,
  case when t > 0 then floor(s / t * 100 + 0.5)::bigint else 0 end as sc_share,
  case when t > 0 then floor(n / t * 100 + 0.5)::bigint else 0 end as npt_share
from (select wellbore, coalesce(sum(p_h), 0.0) as p, coalesce(sum(sc_h), 0.0) as s, coalesce(sum(npt_h), 0.0) as n,
  coalesce(sum(total_h), 0.0) as t
  from records r left join record_hours h on h.record_id = r.record_id group by wellbore)
""",
    uses=("records", "record_hours"),
)
def hour_shares(i):
    from tourlog.operators.wells import hour_shares

    return hour_shares(i.v("records").join(i.v("record_hours"), "record_id", "left"))


@query(
    "well_search",
    """
select record_id, wellbore, report_date from records
where lower(wellbore) like '%w-02%' and report_date like '1998-0%'
""",
    uses=("records",),
)
def well_search(i):
    from tourlog.operators.wells import well_search

    return well_search(i.v("records"), text="w-02", month="1998-0").select("record_id", "wellbore", "report_date")
