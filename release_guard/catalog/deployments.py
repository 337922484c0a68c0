"""Deployment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import frame, with_views
from ..operators import deployments as d


def _deployments(sp, sf):
    return frame(sp, sf, "fx_deployments")


def requests(sp, sf):
    return frame(sp, sf, "fx_requests")


def _pending(sp, sf):
    return d.pending_approvals(requests(sp, sf), d.environment_table(sp))


def _wanted(sp, sf):
    """Ids to look up: the runs of the test table, most of them no deployment."""
    return frame(sp, sf, "fx_vulns").select((F.col("project_id") * 7).alias("seq"))


def _environments(sp, sf):
    """The environments after all changes, approvers as text."""
    changed = d.upsert_environments(d.environment_table(sp), frame(sp, sf, "fx_env_updates"))
    return changed.withColumn("required_approvers", F.array_join("required_approvers", ","))


QUERIES = {
    "deployments_query": lambda sp, sf: d.deployments_query(_deployments(sp, sf), "production", "success", 50),
    "deployments_all": lambda sp, sf: d.deployments_query(_deployments(sp, sf), "staging"),
    "validate_requests": lambda sp, sf: d.validate_requests(
        requests(sp, sf), d.environment_table(sp), d.strategy_table(sp)
    ),
    "pending_approvals": _pending,
    "approval_state": lambda sp, sf: d.approval_state(_pending(sp, sf), frame(sp, sf, "fx_approval_actions")),
    "deployment_state": lambda sp, sf: d.deployment_state(
        requests(sp, sf), d.environment_table(sp), frame(sp, sf, "fx_approval_actions")
    ),
    "rollback_target": lambda sp, sf: d.rollback_target(_deployments(sp, sf)),
    "success_rate": lambda sp, sf: d.success_rate(_deployments(sp, sf)),
    "deployment_duration_ms": lambda sp, sf: d.deployment_durations(_deployments(sp, sf)).select("seq", "duration_ms"),
    "deployment_by_id": lambda sp, sf: d.deployment_by_id(_deployments(sp, sf), _wanted(sp, sf)),
    "upsert_environments": _environments,
    "first_errors": lambda sp, sf: d.first_errors(frame(sp, sf, "fx_deploy_logs"), 3),
    "last_logs": lambda sp, sf: d.last_logs(frame(sp, sf, "fx_deploy_logs"), 3),
}

DEPLOYMENTS = with_views("fx_deployments")
ENVIRONMENTS = """envs(environment, default_strategy, env_auto, required) as (values
 ('development', 'recreate', true, cast([] as varchar[])), ('staging', 'blue-green', false, ['dev-lead']),
 ('production', 'canary', false, ['dev-lead', 'ops-lead']))"""
PENDING = f"""{with_views('fx_requests', 'fx_approval_actions')}, {ENVIRONMENTS}, pending as (
 select deployment_id, r.environment, unnest(required) as approver from fx_requests r join envs e
 on e.environment = r.environment where not env_auto and not auto_approve)"""
APPROVALS = f"""{PENDING},
 rejects as (select deployment_id, min((ts, seq)) as first_reject from fx_approval_actions
 where action = 'reject' group by deployment_id),
 votes as (select deployment_id, approver, min((ts, seq)) filter (action = 'approve') as first_approve,
 bool_or(action = 'reject') as rejected from fx_approval_actions group by deployment_id, approver),
 approvals as (select p.deployment_id, p.environment, p.approver, case when rejected then 'rejected'
 when first_approve is not null and (first_reject is null or first_approve < first_reject) then 'approved'
 else 'pending' end as status from pending p left join votes v on v.deployment_id = p.deployment_id
 and v.approver = p.approver left join rejects x on x.deployment_id = p.deployment_id)"""
VALID = """valid as (select deployment_id, case when environment = 'qa' then 'Environment ''qa'' not found'
 when strategy = 'big-bang' then 'Deployment strategy ''big-bang'' not found' end as error from fx_requests)"""
LOGS = with_views("fx_deploy_logs")

ORACLES = {
    "deployments_query": f"""{DEPLOYMENTS} select * from fx_deployments
 where environment = 'production' and status = 'success' order by seq desc limit 50""",
    "deployments_all": f"{DEPLOYMENTS} select * from fx_deployments where environment = 'staging'",
    "validate_requests": f"""{with_views('fx_requests')}, {ENVIRONMENTS}
 select deployment_id, name, environment, chosen as strategy, auto_approve,
 case when default_strategy is null then concat('Environment ''', environment, ''' not found')
 when chosen not in ('recreate', 'rolling', 'blue-green', 'canary')
 then concat('Deployment strategy ''', chosen, ''' not found') end as error
 from (select r.*, e.default_strategy, coalesce(nullif(strategy, ''), e.default_strategy) as chosen
 from fx_requests r left join envs e on e.environment = r.environment)""",
    "pending_approvals": f"{PENDING} select *, 'pending' as status from pending",
    "approval_state": f"{APPROVALS} select * from approvals",
    "deployment_state": f"""{APPROVALS}, {VALID} select r.deployment_id, r.environment,
 case when error is null then coalesce(open_approvals, 0) else 0 end as open_approvals,
 case when error is not null then 'invalid' when x.deployment_id is not null then 'cancelled'
 when coalesce(open_approvals, 0) = 0 then 'approved' else 'pending' end as status, error
 from fx_requests r left join (select deployment_id, count(*) filter (status = 'pending') as open_approvals
 from approvals group by deployment_id) o on o.deployment_id = r.deployment_id
 left join rejects x on x.deployment_id = r.deployment_id and x.first_reject is not null
 left join valid v on v.deployment_id = r.deployment_id""",
    "rollback_target": f"""{DEPLOYMENTS} select * from fx_deployments where status = 'success'
 qualify row_number() over (partition by environment order by completed_at desc, seq desc) = 2""",
    "success_rate": f"""{DEPLOYMENTS} select environment, count(*) as finished,
 avg(case when status = 'success' then 1 else 0 end) as success_rate
 from fx_deployments where completed_at is not null group by environment""",
    "deployment_duration_ms": f"""{DEPLOYMENTS} select seq,
 date_diff('millisecond', created_at, completed_at) as duration_ms from fx_deployments""",
    "deployment_by_id": f"""{with_views('fx_deployments', 'fx_vulns')} select * from fx_deployments
 where seq in (select project_id * 7 from fx_vulns)""",
    "upsert_environments": f"""{with_views('fx_env_updates')},
 every as (select name, seq as added_by, type, deployment_strategy, auto_approve, required_approvers from fx_env_updates
 where op = 'add' union all values ('development', null, 'development', 'recreate', true, cast([] as varchar[])),
 ('staging', null, 'staging', 'blue-green', false, ['dev-lead']),
 ('production', null, 'production', 'canary', false, ['dev-lead', 'ops-lead'])),
 ranked as (select *, row_number() over (partition by name order by added_by nulls first) as place from every),
 changes as (select u.*, r.name is not null and (r.added_by is null or u.seq > r.added_by) as there
 from fx_env_updates u left join ranked r on r.name = u.name and r.place = 1 where u.op = 'update'),
 given as (select name, arg_max(type, seq) filter (type is not null) as t,
 arg_max(deployment_strategy, seq) filter (deployment_strategy is not null) as d,
 arg_max(auto_approve, seq) filter (auto_approve is not null) as a,
 arg_max(required_approvers, seq) filter (required_approvers is not null) as r from changes where there group by name)
 select name, added_by, case when place = 1 then coalesce(t, type) else type end as type,
 case when place = 1 then coalesce(d, deployment_strategy) else deployment_strategy end as deployment_strategy,
 case when place = 1 then coalesce(a, auto_approve) else auto_approve end as auto_approve,
 array_to_string(case when place = 1 then coalesce(r, required_approvers) else required_approvers end, ',') as required_approvers,
 null as error from ranked left join given using (name)
 union all select name, seq, type, deployment_strategy, auto_approve, array_to_string(required_approvers, ','),
 concat('Environment ''', name, ''' not found') from changes where not there""",
    "first_errors": f"""{LOGS} select deployment_id, concat(string_agg(message, chr(10) order by rn) filter (rn <= 3),
 case when max(rn) > 3 then concat(chr(10), '...') else '' end) as errors from (select *,
 row_number() over (partition by deployment_id order by ts, seq, message) as rn from fx_deploy_logs
 where level = 'error') group by deployment_id""",
    "last_logs": f"""{LOGS} select deployment_id, string_agg(message, chr(10) order by rn desc) as recent from (
 select *, row_number() over (partition by deployment_id order by ts desc, seq desc, message desc) as rn
 from fx_deploy_logs) where rn <= 3 group by deployment_id""",
}
