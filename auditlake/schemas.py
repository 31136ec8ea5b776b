"""Row shapes shared by the operators (all of them also accept other column names)."""

FINDING = (
    "category STRING, vuln_type STRING, severity INT, severity_label STRING, id STRING, cwe STRING, "
    "location STRING, function_name STRING, line_number INT, vulnerable_code STRING, description STRING, "
    "attack_scenario STRING, real_world_incident STRUCT<project:STRING,loss:STRING,date:STRING>, "
    "secure_fix STRING, prevention STRING, confidence INT"
)
SOURCE_FILE = "program STRING, file_path STRING, file_name STRING, content STRING"
NPM_MANIFEST = (
    "name STRING, version STRING, dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>, "
    "peerDependencies MAP<STRING,STRING>, optionalDependencies MAP<STRING,STRING>, scripts MAP<STRING,STRING>"
)
ADVISORY = (
    "id STRING, package STRING, ecosystem STRING, affected_versions ARRAY<STRING>, severity STRING, "
    "title STRING, description STRING, cve STRING, reference STRING, remediation STRING"
)
GUARD_FINDING = (
    "package_name STRING, version STRING, ecosystem STRING, severity STRING, category STRING, "
    "title STRING, source_file STRING"
)
AUTHORITY_EVENT = (
    "program_id STRING, authority STRING, detected_at TIMESTAMP, slot BIGINT"
)
PERFORMANCE_SAMPLE = (
    "validator STRING, slot BIGINT, ts TIMESTAMP, num_slots BIGINT, num_transactions BIGINT, "
    "sample_period_secs INT, block_time BIGINT, latency_ms BIGINT"
)
VOTE = "finding_id STRING, model STRING, verdict STRING, confidence DOUBLE"

#: Default confidence of a finding whose detector states none.
DEFAULT_CONFIDENCE = 50
