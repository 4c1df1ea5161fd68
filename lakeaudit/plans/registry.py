"""The registered audit queries, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detect import detect
from ..functions.stage import spread
from ..operators.compliance import guard_compliance, parse_compliance
from ..operators.findings import display, exposures, find, numbered, seen, summary
from ..operators.guard import guard, redact_trace
from ..operators.segments import external_path, segments
from ..sources.mapping import apply_mapping, counts
from ..sources.policy import parse_policy
from ..sources.trace import from_columns, parse
from . import fixtures as fx
from .corpus import coverage

POLICY, COMPLIANCE = parse_policy(fx.POLICY), parse_compliance(fx.COMPLIANCE)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A fixture's SQL over the tables it names."""
    for name in ("orders", "customer", "events"):
        if f"from {name}" in text:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(text)


def order_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_columns(_sql(spark, sf_dir, fx.TRACE))


F1 = f"""f1 as ({fx.TRACE}),
cand as (select event_no, event_id, layer, content, 'claim_id' as category, regexp_extract(content, 'CLM-SYN-[0-9]+') as value, cast(0.93 as double) as confidence, 'Matched a labeled claim or authorization identifier.' as reason from f1
 union all select event_no, event_id, layer, content, 'member_id', regexp_extract(content, 'MBR-SYN-[0-9]+'), 0.95, 'Matched a labeled member, subscriber, or health plan identifier.' from f1
 union all select event_no, event_id, layer, content, 'date', regexp_extract(content, 'Service date: ([0-9-]+)', 1), 0.82, 'Matched an individual-related healthcare date.' from f1
 union all select event_no, event_id, layer, content, 'phone', regexp_extract(content, 'callback (555-013-[0-9]+)', 1), 0.92, 'Matched a phone number.' from f1),
spanned as (select *, strpos(content, value) - 1 as s, strpos(content, value) - 1 + length(value) as e from cand),
decided as (select *, case when layer = 'debug_log' or (layer = 'model_input' and category = 'phone') then 'violation' when layer = 'user_message' then 'allowed' else 'redact' end as disposition,
  '[REDACTED_' || upper(category) || ']' as redaction, 'sha256:' || sha256(value) as value_hash, row_number() over (order by event_no, s) as no from spanned),
ranked as (select *, case disposition when 'violation' then 2 when 'redact' then 1 else 0 end as r, printf('finding-%03d', no) as finding_id from decided)"""

ACTION = "case {0} when 'violation' then 'Remove or redact before ' || {1} || '.' when 'redact' then 'Redact before ' || {1} || '.' else 'Review only; no policy boundary action required.' end"


@query(f"select event_id, event_no, timestamp, layer, content from ({fx.TRACE})")
def trace_scan(spark, sf_dir):
    return order_trace(spark, sf_dir).select("event_id", "event_no", "timestamp", "layer", "content")


@query(f"select layer, count(*) as n from ({fx.TRACE}) group by layer")
def layer_counts(spark, sf_dir):
    return order_trace(spark, sf_dir).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query(f"""select event_no, case when content is null then 'missing required field(s): content' when event_id is null then 'missing required field(s): event_id'
  when layer = 'external_vendor' then 'unsupported layer ''external_vendor''; expected one of: debug_log, memory, model_input, rag_context, tool_output, user_message' end as error from ({fx.FAULTY})""")
def trace_validate_errors(spark, sf_dir):
    rows = _sql(spark, sf_dir, fx.FAULTY).withColumn("value", F.to_json(F.struct("event_id", "timestamp", "layer", "content")))
    return parse(rows.withColumn("line_no", F.col("event_no")).select("line_no", "event_no", "value")).select("event_no", "error")


_LEAVES = f"""with o as (select cast(o_orderkey as bigint) as event_no, o_orderkey, o_custkey, cast(cast(o_orderdate as date) as varchar) as day from orders),
l as (select event_no, 0 as seg_no, '$.member_id' as content_path, 'Member ID: MBR-SYN-' || lpad(cast(o_custkey as varchar), 8, '0') as text from o
 union all select event_no, 1, '$.tool.response.claim_id', 'CLM-SYN-' || lpad(cast(o_orderkey as varchar), 8, '0') from o
 union all select event_no, 2, '$.messages[0].role', 'user' from o union all select event_no, 3, '$.messages[0].content', 'Service date ' || day from o
 union all select event_no, 4, '$.n', cast(o_orderkey % 7 as varchar) from o union all select event_no, 5, '$.ok', 'True' from o)"""


@query(f"{_LEAVES} select event_no, seg_no, content_path, text from l")
def content_segments(spark, sf_dir):
    return segments(_sql(spark, sf_dir, fx.JSON_ORDERS)).select("event_no", "seg_no", "content_path", "text")


@query(f"{_LEAVES} select event_no, content_path, 'payload' || substr(content_path, 2) as external_content_path from l")
def external_paths(spark, sf_dir):
    rows = segments(_sql(spark, sf_dir, fx.JSON_ORDERS).withColumn("external_content_paths", F.array(F.lit("payload"))))
    return rows.select("event_no", "content_path", external_path().alias("external_content_path"))


def _one_category(df: DataFrame, text: str, key: str, category: str) -> DataFrame:
    found = detect(spread(df.select(key, text)), text).select(key, F.explode("candidates").alias("c")).where(F.col("c.category") == category)
    return found.select(key, "c.value", "c.start", "c.end")


@query("select page_id, regexp_extract(url, 'https?://[^\\s<>\\]\\)\"'']+') as value, 0 as start, length(regexp_extract(url, 'https?://[^\\s<>\\]\\)\"'']+')) as \"end\" from pages where regexp_matches(url, '^https?://')")
def detect_url(spark, sf_dir):
    return _one_category(spark.read.parquet(f"{sf_dir}/pages.parquet"), "url", "page_id", "url")


@query("select doc_id, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b')) as m from documents) group by doc_id")
def detect_email(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _one_category(docs, "text", "doc_id", "email").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '\\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\\b')) as m from documents) group by doc_id")
def detect_ip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _one_category(docs, "text", "doc_id", "ip_address").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.explode("candidates").alias("c")).select(*keys, "c.category", "c.value", "c.start", "c.end", "c.confidence", "c.reason")


@query(f"with {F1} select event_no, category, value, s as start, e as \"end\", confidence, reason from ranked")
def candidates_merged(spark, sf_dir):
    return _flat(detect(order_trace(spark, sf_dir)), "event_no")


@query(f"""with f4 as ({fx.OVERLAP}), c as (select event_no, content, 'url' as category, regexp_extract(content, 'https://[^ ]+') as value from f4
 union all select event_no, content, 'phone', regexp_extract(content, 'fax=(555-013-[0-9]+)', 1) from f4 union all select event_no, content, 'ip_address', regexp_extract(content, '192\\.0\\.2\\.[0-9]+') from f4
 union all select event_no, content, 'email', regexp_extract(content, 'mail (c[0-9]+@example\\.org)', 1) from f4) select event_no, category, value, strpos(content, value) - 1 as start, strpos(content, value) - 1 + length(value) as "end" from c""")
def overlap_merge(spark, sf_dir):
    return _flat(detect(_sql(spark, sf_dir, fx.OVERLAP)), "event_no").drop("confidence", "reason")


@query()
def detect_all_documents(spark, sf_dir):
    return _flat(detect(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "text"), "doc_id")


@query("select conv_id, turn, text as value from conversations where false")
def zero_findings(spark, sf_dir):
    df = detect(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text"), "text")
    return df.select("conv_id", "turn", F.explode("candidates.value").alias("value"))


@query(f"""with {F1} select event_id, layer, category, value, disposition, 'high' as risk, redaction, value_hash,
  category || case disposition when 'violation' then ' is denied in ' || layer when 'redact' then ' requires redaction in ' || layer else ' has no layer-specific restriction for ' || layer end || '.' as rule,
  case disposition when 'violation' then 'remove_or_redact_before_this_layer' when 'redact' then 'redact_before_this_layer' else 'review' end as action from ranked""")
def findings_policy(spark, sf_dir):
    return find(order_trace(spark, sf_dir), POLICY, number=False).select("event_id", "layer", "category", "value", "disposition", "risk", "redaction", "value_hash", "rule", "action")


@query(f"with {F1} select finding_id, event_id, category, s as start from ranked")
def finding_ids(spark, sf_dir):
    return find(order_trace(spark, sf_dir), POLICY).select("finding_id", "event_id", "category", "start")


@query(f"with {F1} select finding_id, category, redaction as value_display from ranked")
def report_redacted(spark, sf_dir):
    return find(order_trace(spark, sf_dir), POLICY).select("finding_id", "category", display("redacted").alias("value_display"))


@query(f"with {F1} select finding_id, category, value_hash as value_display from ranked")
def report_hashed(spark, sf_dir):
    return find(order_trace(spark, sf_dir), POLICY).select("finding_id", "category", display("hashed").alias("value_display"))


_EXPOSED = f"""with {F1}, g as (select category, value, min(value_hash) as value_hash, string_agg(finding_id, ',' order by no) as finding_ids, arg_min(event_id, no) as first_seen_event_id,
  arg_max(disposition, r * 1000000000 - no) as worst_disposition, arg_max(layer, r * 1000000000 - no) as worst_layer, max(r) as r from ranked group by category, value),
l as (select category, value, string_agg(layer, ',' order by m) as layers_seen from (select category, value, layer, min(no) as m from ranked group by all) group by category, value)"""


@query(f"""{_EXPOSED} select printf('exposure-%03d', row_number() over (order by -g.r, first_seen_event_id, g.category, g.value)) as exposure_id, g.category, g.value, value_hash, finding_ids, layers_seen,
  first_seen_event_id, worst_disposition, worst_layer, {ACTION.format('worst_disposition', 'worst_layer')} as action from g join l on g.category = l.category and g.value = l.value""")
def boundary_exposures(spark, sf_dir):
    out = exposures(find(order_trace(spark, sf_dir), POLICY), lists=["finding_ids"])
    return out.select("exposure_id", "category", "value", "value_hash", F.array_join("finding_ids", ",").alias("finding_ids"), F.array_join("layers_seen", ",").alias("layers_seen"), "first_seen_event_id", "worst_disposition", "worst_layer", F.col("recommended_boundary_action").alias("action"))


@query(f"""{_EXPOSED} select 'disposition' as kind, disposition as key, count(*) as n from ranked group by disposition union all select 'layer', layer, count(*) from ranked group by layer
  union all select 'category', category, count(*) from ranked group by category union all select 'worst_disposition', worst_disposition, count(*) from g group by worst_disposition
  union all select 'total', 'findings', count(*) from ranked union all select 'total', 'high_risk', count(*) from ranked union all select 'total', 'exposures', count(*) from g""")
def audit_summary(spark, sf_dir):
    return summary(seen(order_trace(spark, sf_dir)), POLICY)


REDACTED = "replace(replace(replace(replace(content, regexp_extract(content, 'CLM-SYN-[0-9]+'), '[REDACTED_CLAIM_ID]'), regexp_extract(content, 'MBR-SYN-[0-9]+'), '[REDACTED_MEMBER_ID]'), regexp_extract(content, 'Service date: ([0-9-]+)', 1), '[REDACTED_DATE]'), regexp_extract(content, '555-013-[0-9]+'), '[REDACTED_PHONE]')"


def _guarded(mode: str):
    sql = f"""select event_id, {REDACTED} as redacted_text, true as has_phi, layer in ('debug_log', 'model_input') as has_violations, {str(mode == 'block_on_violation').lower()} and layer in ('debug_log', 'model_input') as should_block,
      {str(mode == 'redact').lower()} as should_redact, case when layer in ('debug_log', 'model_input') then 'violation' when layer = 'user_message' then 'allowed' else 'redact' end as worst_disposition, cast(4 as bigint) as finding_count from ({fx.TRACE})"""

    def run(spark, sf_dir):
        out = guard(order_trace(spark, sf_dir), POLICY, mode, text="content")
        return out.select("event_id", "redacted_text", "has_phi", "has_violations", "should_block", "should_redact", "worst_disposition", "finding_count")

    run.__name__ = f"guard_{mode}"
    query(sql)(run)


for _mode in ("report_only", "redact", "block_on_violation"):
    _guarded(_mode)


@query(f"select event_id, {REDACTED} as redacted_content from ({fx.TRACE})")
def redacted_trace(spark, sf_dir):
    return redact_trace(order_trace(spark, sf_dir), POLICY, keep=["event_id"])


@query(f"""with e as ({fx.NESTED}), o as (select cast(o_orderkey as bigint) as event_no, o_custkey, o_orderkey % 4 as k from orders), u as (select distinct o_custkey from o where k = 2), m as (select distinct o_custkey from o where k = 0)
 select event_id, case k when 0 then 'Member ID: [REDACTED_MEMBER_ID].' when 2 then 'see [REDACTED_URL] now' else case when u.o_custkey is not null then 'seen z[REDACTED_URL]z again' when m.o_custkey is not null then 'seen zhttps://x.test/[REDACTED_MEMBER_ID]z again' else content end end as redacted_content
 from e join o on e.event_no = o.event_no left join u on u.o_custkey = o.o_custkey left join m on m.o_custkey = o.o_custkey""")
def redacted_trace_nested(spark, sf_dir):
    return redact_trace(from_columns(_sql(spark, sf_dir, fx.NESTED)), POLICY, keep=["event_id"])


@query(f"""with e as ({fx.JSON_TRACE}), o as (select e.*, c.o_custkey from e join orders c on e.event_no = c.o_orderkey),
 f as (select event_no, 0 as seg, event_id, layer, source, base, 'member_id' as category, 'MBR-SYN-' || lpad(cast(o_custkey as varchar), 8, '0') as value, 'tool.refs[0]' as path from o
  union all select event_no, 1, event_id, layer, source, base, 'claim_id', 'CLM-SYN-' || lpad(cast(event_no as varchar), 8, '0'), 'tool.refs[1]' from o
  union all select event_no, 2, event_id, layer, source, base, 'member_id', 'MBR-SYN-' || lpad(cast(o_custkey as varchar), 8, '0'), 'member' from o),
 seen as (select category, value, kind, x, min(event_no * 4 + seg) as pos from (select *, unnest([{{'kind': 'e', 'x': event_id}}, {{'kind': 'l', 'x': layer}}, {{'kind': 's', 'x': source}}, {{'kind': 'p', 'x': '$.' || path}}, {{'kind': 'b', 'x': base || '.' || path}}]) as u from f) q, lateral (select u.kind as kind, u.x as x) v where x is not null group by all),
 g as (select category, value, count(*) as n from f group by all)
 select g.category, g.value, g.n as n_findings, {', '.join(f"coalesce(string_agg(x, ' ' order by pos) filter (where kind = '{k}'), '') as {n}" for k, n in (('e', 'event_ids'), ('l', 'layers_seen'), ('s', 'sources'), ('p', 'content_paths'), ('b', 'external_paths')))}
 from g join seen on g.category = seen.category and g.value = seen.value group by g.category, g.value, g.n""")
def exposure_lists(spark, sf_dir):
    events = _sql(spark, sf_dir, fx.JSON_TRACE).withColumn("external_content_paths", F.when(F.col("base").isNotNull(), F.array("base"))).drop("base")
    lists = {"event_ids": "event_ids", "layers_seen": "layers_seen", "sources": "sources", "content_paths_seen": "content_paths", "external_content_paths_seen": "external_paths"}
    out = exposures(find(from_columns(events), POLICY, number=False), number=False, lists=list(lists))
    return out.select("category", "value", "n_findings", *[F.array_join(c, " ").alias(n) for c, n in lists.items()])


_RULES = """case when not phi then [] when service_id is null then ['unknown_service_profile'] else list_filter([
  case when service_id = 'svc_consumer' and phi_status <> 'synthetic' then 'phi_status_not_allowed_for_service' end,
  case when service_id = 'svc_consumer' and phi_status <> 'synthetic' then 'phi_status_requires_baa_but_service_is_not_covered' end,
  case when service_id in ('svc_consumer', 'svc_pending') and phi_status <> 'synthetic' then 'phi_status_requires_baa_but_baa_is_not_confirmed' end,
  case when service_id <> 'svc_consumer' and regexp_matches(model, 'preview|beta') then 'model_matches_denied_pattern' end,
  case when service_id = 'svc_ga' and feature = 'web_search' then 'feature_denied_for_service' end,
  case when service_id <> 'svc_consumer' and feature <> 'online_prediction' then 'feature_not_allowed_for_service' end,
  case when (service_id = 'svc_consumer' and logging <> 'metadata_only') or (service_id <> 'svc_consumer' and logging not in ('metadata_only', 'redacted_only')) then 'logging_mode_not_allowed_for_phi' end,
  case when storage <> 'none' then 'storage_mode_not_allowed_for_phi' end,
  case when environment = 'production' and logging = 'raw' then 'environment_requires_redacted_logging' end], lambda x: x is not null) end"""


@query(f"""with q as (select *, text like 'claim_id%' as phi, case when vendor <> 'acme' then null when service = 'consumer_ai' then 'svc_consumer' when regexp_matches(model, '^ga-model-.$') then 'svc_ga' when model like 'ga-model-%' then 'svc_pending' end as service_id from ({fx.REQUESTS})),
 d as (select *, list_concat(case when phi and layer = 'debug_log' then ['phi_policy_violation'] else [] end, {_RULES}) as reasons from q)
 select request_id, service_id, len(reasons) > 0 as should_block, array_to_string(reasons, ',') as block_reasons, case when service_id is null and not phi then 'unknown_service_profile' else '' end as warnings from d""")
def compliance_decision(spark, sf_dir):
    out = guard_compliance(_sql(spark, sf_dir, fx.REQUESTS), POLICY, COMPLIANCE)
    return out.select("request_id", "service_id", "should_block", F.array_join("block_reasons", ",").alias("block_reasons"), F.array_join("warnings", ",").alias("warnings"))


def _external(spark, sf_dir):
    lines = _sql(spark, sf_dir, fx.EXTERNAL)
    return apply_mapping(numbered(lines, ["line_no"], "event_no", cheap=True), fx.MAPPING)


_ADAPTED = """with x as (select cast(event_id as bigint) + 1 as line_no, row_number() over (order by event_id) as no, * from events),
 a as (select line_no, no, case when event_id % 4 = 0 then printf('ext_%04d', no) else 'e' || event_id end as event_id,
 case event_type when 'click' then 'user_message' when 'view' then 'rag_context' when 'purchase' then 'tool_output' when 'signup' then 'memory' else 'debug_log' end as layer,
 'user: Member ID: MBR-SYN-' || lpad(cast(user_id as varchar), 6, '0') as content, '{"path": "n' || (user_id % 5) || '", "type": "svc"}' as source, case when event_id % 5 = 0 then '[{"layer": "model_input", "path": "ctx[0]"}]' else '[]' end as destinations,
 event_id % 4 as m4, event_id % 3 as m3, event_id % 2 as m2, event_id % 5 as m5 from x)"""


@query(f"{_ADAPTED} select line_no, event_id, layer, content, source, destinations from a")
def adapter_normalize(spark, sf_dir):
    return _external(spark, sf_dir).select("line_no", "event_id", "layer", "content", "source", "destinations")


@query(f"""{_ADAPTED}, c as (select 'event_id' || chr(9) || case m4 when 0 then '<generated>' when 1 then 'event.id' else 'id' end as key from a union all select 'timestamp' || chr(9) || case m3 when 0 then 'timestamp' else 'created_at' end from a
 union all select 'layer' || chr(9) || case m2 when 0 then 'kind' else 'event_type' end from a union all select 'source.type' || chr(9) || 'component.name' from a union all select 'source.path' || chr(9) || 'component.path' from a
 union all select 'destinations[0].layer' || chr(9) || 'next.layer' from a where m5 = 0 union all select 'destinations[0].path' || chr(9) || 'next.path' from a where m5 = 0)
 select 'total' as kind, 'events' as key, count(*) as n from a union all select 'layer', layer, count(*) from a group by layer union all select 'destination', 'model_input', count(*) from a where m5 = 0
 union all select 'path', 'messages.0.content', count(*) from a union all select 'chosen', key, count(*) from c group by key""")
def adapter_diagnostics(spark, sf_dir):
    return counts(_external(spark, sf_dir))


@query(f"""with {F1}, t as (select 't' || (event_no % 7) as trace, * from ranked), e as (select 't' || (event_no % 7) as trace, count(*) as events from f1 group by 1)
 select e.trace, e.events, count(*) as findings, count(distinct category || value) as exposures, count(*) filter (where category = 'phone') as phones, count(*) filter (where layer = 'memory') as in_memory from e join t on e.trace = t.trace group by e.trace, e.events""")
def corpus_coverage(spark, sf_dir):
    events = order_trace(spark, sf_dir).withColumn("trace", F.concat(F.lit("t"), F.col("event_no") % 7))
    out = coverage(events, POLICY)
    return out.select("trace", "events", "findings", "exposures", F.coalesce(F.col("categories")["phone"], F.lit(0)).alias("phones"), F.coalesce(F.col("layers")["memory"], F.lit(0)).alias("in_memory"))
