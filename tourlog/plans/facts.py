"""Views that the reporting queries share: projects, hours and record facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tourlog.operators import assignment
from tourlog.operators.production import hours_by_record
from tourlog.plans.registry import cte, view


@view("bindings")
def bindings(inputs) -> DataFrame:
    no_wells = F.array().cast("array<string>")
    return inputs.v("project_rigs").withColumn(
        "wells", F.when(F.col("well") == "", no_wells).otherwise(F.array("well"))
    )


@view("team_list")
def team_list(inputs) -> DataFrame:
    teams = inputs.v("team_names")
    return teams.select("team_ord", F.explode(F.array("team_name", "alias")).alias("name")).distinct()


@view("project_windows")
def project_windows(inputs) -> DataFrame:
    return assignment.project_windows(inputs.v("bindings"), inputs.v("team_list"))


@view("record_hours")
def record_hours(inputs) -> DataFrame:
    return hours_by_record(inputs.v("operations"))


@view("facts")
def facts(inputs) -> DataFrame:
    """Reports with project and pre-summed hours; one row per report and project."""
    records = assignment.with_projects(inputs.v("records"), inputs.v("project_windows"), project_mode=False)
    return records.join(inputs.v("record_hours"), "record_id", "left")


@view("project_facts")
def project_facts(inputs) -> DataFrame:
    records = assignment.with_projects(inputs.v("records"), inputs.v("project_windows"), project_mode=True)
    return records.join(inputs.v("record_hours"), "record_id", "left")


cte(
    "assigned",
    """
select distinct r.record_id, p.project_id,
  case when p.project_title <> '' then p.project_title else p.project_contract end as project_name, p.project_contract
from records r join project_rigs p
  on (r.rig = p.rig or replace(p.rig, 'OLD RIG ', 'ACME 10') = r.rig or p.rig = replace(r.rig, 'ACME 10', 'OLD RIG '))
 and p.project_status in ('active', '') and r.rig_ok
 and r.report_date between p.project_start and p.project_end
 and (p.rig_end = '' or r.report_date <= p.rig_end)
 and (p.well = '' or p.well = r.wellbore)
""",
    "records",
    "project_rigs",
)

cte(
    "record_hours",
    """
select record_id, count(*) as n_ops, sum(h) as total_h,
  sum(case when eff_type = 'P' then h else 0.0 end) as p_h, sum(case when eff_type = 'SC' then h else 0.0 end) as sc_h,
  sum(case when eff_type = 'NPT' then h else 0.0 end) as npt_h, count(*) filter (eff_type = 'NPT') as n_npt
from operations group by record_id
""",
    "operations",
)

for _name, _id, _label in (("facts", "", ""), ("project_facts", "__unassigned__", "未归属项目")):
    cte(
        _name,
        f"""
select r.*, coalesce(a.project_id, '{_id}') as project_id, coalesce(a.project_name, '{_label}') as project_name,
  coalesce(a.project_contract, '') as project_contract, h.n_ops, h.total_h, h.p_h, h.sc_h, h.npt_h, h.n_npt
from records r left join assigned a on r.record_id = a.record_id left join record_hours h on h.record_id = r.record_id
""",
        "records",
        "assigned",
        "record_hours",
    )
