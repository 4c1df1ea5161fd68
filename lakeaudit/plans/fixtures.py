"""Traces and requests made from the star schema, the same in Spark and DuckDB."""

CATEGORY_LIST = ["name", "dob", "date", "phone", "fax", "email", "ssn", "address", "zip_code", "member_id", "claim_id", "mrn", "policy_number", "group_number", "account_number", "license_number", "vehicle_id", "device_id", "url", "ip_address"]
HARD = {"phone", "fax", "address", "ssn", "mrn", "zip_code"}
POLICY = {
    "version": 1,
    "categories": {c: {"high_risk": True, "deny_layers": ["debug_log", *(["model_input"] if c in HARD else [])], "redact_layers": ["model_input", "rag_context", "tool_output", "memory"], "redaction": f"[REDACTED_{c.upper()}]"} for c in CATEGORY_LIST},
}
COMPLIANCE = {
    "version": 1,
    "default_action": "block",
    "phi_statuses": {"synthetic": {"requires_baa": False}, "deidentified": {"requires_baa": True}, "real_phi": {"requires_baa": True}},
    "environments": {"development": {"require_redacted_logging": False}, "production": {"require_redacted_logging": True}},
    "services": {
        "svc_ga": {"vendor": "acme", "service": "covered_ai", "covered_service": True, "baa_executed": True, "allowed_phi_status": ["synthetic", "deidentified", "real_phi"], "model_patterns": ["ga-model-?"], "allowed_features": ["online_prediction"], "denied_features": ["web_search"], "allowed_logging": ["metadata_only", "redacted_only"], "allowed_storage": ["none"]},
        "svc_pending": {"vendor": "acme", "service": "covered_ai", "covered_service": True, "baa_executed": False, "allowed_phi_status": ["synthetic", "deidentified", "real_phi"], "model_patterns": ["ga-model-*"], "denied_model_patterns": ["*preview*", "*beta*"], "allowed_features": ["online_prediction"], "allowed_logging": ["metadata_only", "redacted_only"], "allowed_storage": ["none"]},
        "svc_consumer": {"vendor": "acme", "service": "consumer_ai", "covered_service": False, "baa_executed": False, "allowed_phi_status": ["synthetic"], "allowed_logging": ["metadata_only"], "allowed_storage": ["none"], "allow_preview": True},
    },
}
MAPPING = {
    "version": 1,
    "event_id": {"fields": ["event.id", "id"], "required": False, "fallback_prefix": "ext"},
    "timestamp": {"fields": ["timestamp", "created_at"]},
    "layer": {"fields": ["kind", "event_type"], "map": {"click": "user_message", "view": "rag_context", "purchase": "tool_output", "signup": "memory", "error": "debug_log"}},
    "content": {"fields": [{"field": "messages.0.content", "label": "user"}]},
    "source": {"type": {"field": "component.name", "default": "svc"}, "path": "component.path"},
    "destinations": [{"layer": {"field": "next.layer", "required": False, "map": {"prompt": "model_input"}}, "path": {"field": "next.path", "required": False}}],
    "metadata": {"constants": {"adapter": "f6"}},
}

TRACE = """select concat('ord_', lpad(cast(o_orderkey as string),8,'0')) as event_id, cast(o_orderkey as bigint) as event_no,
 cast(cast(o_orderdate as date) as string) as timestamp,
 case o_orderkey % 6 when 0 then 'user_message' when 1 then 'rag_context' when 2 then 'tool_output' when 3 then 'model_input' when 4 then 'memory' else 'debug_log' end as layer,
 concat('Claim review claim_id=CLM-SYN-', lpad(cast(o_orderkey as string),8,'0'), ' Member ID: MBR-SYN-', lpad(cast(o_custkey as string),8,'0'),
  '. Service date: ', cast(cast(o_orderdate as date) as string), ' callback 555-013-', lpad(cast(o_orderkey % 10000 as string),4,'0'), '.') as content from orders"""
FAULTY = """select case when event_no % 10 = 2 then null else event_id end as event_id, event_no, timestamp,
 case when event_no % 10 = 0 then 'external_vendor' else layer end as layer, case when event_no % 10 = 1 then null else content end as content from ({trace}) f1""".replace("{trace}", TRACE)
#: Values that rules find in some events and that stand inside longer words, where no rule finds them, in others; some values hold others.
NESTED = """select concat('n_', cast(o_orderkey as string)) as event_id, cast(o_orderkey as bigint) as event_no, cast(cast(o_orderdate as date) as string) as timestamp, 'tool_output' as layer,
 case o_orderkey % 4 when 0 then concat('Member ID: MBR-SYN-', lpad(cast(o_custkey as string),8,'0'), '.') when 2 then concat('see https://x.test/MBR-SYN-', lpad(cast(o_custkey as string),8,'0'), ' now')
 else concat('seen zhttps://x.test/MBR-SYN-', lpad(cast(o_custkey as string),8,'0'), 'z again') end as content from orders"""
#: JSON content with a value twice in an event, sources of three types, and half of the events from external logs.
JSON_TRACE = """select concat('j_', cast(o_orderkey as string)) as event_id, cast(o_orderkey as bigint) as event_no, cast(cast(o_orderdate as date) as string) as timestamp,
 case o_orderkey % 3 when 0 then 'user_message' when 1 then 'memory' else 'debug_log' end as layer, concat('{"type": "t', cast(o_orderkey % 3 as string), '"}') as source, case when o_orderkey % 2 = 0 then 'payload' end as base,
 concat('{"tool":{"refs":["MBR-SYN-', lpad(cast(o_custkey as string),8,'0'), '","CLM-SYN-', lpad(cast(o_orderkey as string),8,'0'), '"]},"member":"Member ID: MBR-SYN-', lpad(cast(o_custkey as string),8,'0'), '"}') as content from orders"""
JSON_ORDERS = """select concat('js_', cast(o_orderkey as string)) as event_id, cast(o_orderkey as bigint) as event_no, concat('{"member_id":"Member ID: MBR-SYN-', lpad(cast(o_custkey as string),8,'0'),
 '","tool":{"response":{"claim_id":"CLM-SYN-', lpad(cast(o_orderkey as string),8,'0'), '"}},"messages":[{"role":"user","content":"Service date ', cast(cast(o_orderdate as date) as string), '"}],"n":', cast(o_orderkey % 7 as string), ',"ok":true,"gap":null,"empty":""}') as content from orders"""
OVERLAP = """select concat('ov_', cast(c_custkey as string)) as event_id, cast(c_custkey as bigint) as event_no, concat('URL https://portal.example.test/member/MBR-SYN-', lpad(cast(c_custkey as string),8,'0'), ' fax=555-013-', lpad(cast(c_custkey % 10000 as string),4,'0'), ' IP 192.0.2.', cast(c_custkey % 256 as string), ' mail c', cast(c_custkey as string), '@example.org end') as content from customer"""
REQUESTS = """select cast(o_orderkey as bigint) as request_id, case o_orderkey % 2 when 0 then 'model_input' else 'debug_log' end as layer,
 case when o_orderkey % 4 = 0 then 'No identifiers here.' else concat('claim_id=CLM-SYN-', lpad(cast(o_orderkey as string),8,'0')) end as text,
 case o_orderkey % 3 when 0 then 'real_phi' when 1 then 'synthetic' else 'deidentified' end as phi_status,
 case when o_orderkey % 11 = 0 then 'unknown' else 'acme' end as vendor, case when o_orderkey % 7 = 0 then 'consumer_ai' else 'covered_ai' end as service,
 case o_orderkey % 5 when 0 then 'ga-model-1' when 1 then 'ga-model-2' when 2 then 'ga-model-preview' when 3 then 'other-model' else 'ga-model-beta' end as model,
 case when o_orderkey % 6 = 0 then 'web_search' when o_orderkey % 6 = 1 then 'batch' else 'online_prediction' end as feature,
 case when o_orderkey % 2 = 0 then 'production' else 'development' end as environment,
 case o_orderkey % 4 when 0 then 'raw' when 1 then 'redacted_only' when 2 then 'metadata_only' else 'none' end as logging,
 case when o_orderkey % 9 = 0 then 'plain_disk' else 'none' end as storage from orders"""
EXTERNAL = """select cast(event_id as bigint) + 1 as line_no, concat('{', case when event_id % 4 = 0 then '' when event_id % 4 = 1 then concat('"event":{"id":"e', cast(event_id as string), '"},') else concat('"id":"e', cast(event_id as string), '",') end,
 case when event_id % 3 = 0 then '"timestamp"' else '"created_at"' end, ':"2024-01-01T00:00:00Z",', case when event_id % 2 = 0 then '"kind"' else '"event_type"' end, ':"', event_type, '",',
 '"component":{"name":"svc","path":"n', cast(user_id % 5 as string), '"},"messages":[{"content":"Member ID: MBR-SYN-', lpad(cast(user_id as string),6,'0'), '"}]', case when event_id % 5 = 0 then ',"next":{"layer":"prompt","path":"ctx[0]"}' else '' end, '}') as value from events"""
