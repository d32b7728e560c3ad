"""Column types of the evidence tables, as DDL, and the domains of their enumerated columns."""

from __future__ import annotations

FLAGS = "truncated boolean, challenge boolean, error_status boolean, non_html boolean, encoding_fallback boolean"
PAGE = f"""struct<flags:struct<{FLAGS.replace(' boolean', ':boolean')}>, status:int, content_type:string, duration_ms:bigint,
 raw_bytes:bigint, decoded_bytes:bigint, encoding:string, charset_declared:boolean, doctype:string, html_lang:string,
 titles:array<string>, descriptions:array<string>, headings:array<struct<level:int,text:string>>,
 robots_meta:array<string>, robots_headers:array<string>, canonicals:array<string>,
 hreflangs:array<struct<lang:string,href:string>>, viewport:string, has_frames:boolean, has_plugin_markup:boolean,
 meta_refresh:array<string>, structured:array<struct<format:string,index:int,raw:string,types:array<string>>>, text:string>""".replace("\n", "")
LINK = "struct<source:string,href:string,destination:string,anchor:string,rel:string,element:string,host_owner:string>"
RESOURCE = "struct<referring:string,kind:string,href:string,destination:string,alt:string,host_owner:string>"
HOP = "struct<from:string,to:string,status:int>"
EVIDENCE = "array<struct<observation_identity:string,field:string,excerpt:string>>"

OBSERVATION = f"identity string, page {PAGE}, links array<{LINK}>, resources array<{RESOURCE}>, redirect_chain array<{HOP}>"
URL_RECORD = "original string, identity string, state string, reason string, click_depth int, via_website boolean, via_sitemap boolean"
SITEMAP_FILE = "url string, identity string, state string, reason string, listed_urls bigint"
SITEMAP_URL = "original string, identity string, skip_reason string, source_sitemap string"
ROBOTS_RUN = """origin string, user_agent string, product_token string, selected_group string, fetch_kind string, fetch_status int,
 sitemaps array<string>, format_errors array<string>, crawl_delay_notes array<string>"""
RESOURCE_FETCH = """identity string, status int, failed_reason string, challenge boolean, credentials_attached boolean,
 robots_blocked boolean, robots_known boolean, content_type string"""
TLS_INSPECTION = """host string, port int, inspected boolean, verified boolean, hostname_ok boolean, not_before_unix bigint,
 not_after_unix bigint, names array<string>, error string"""
HOST_PROBE = f"kind string, requested_url string, destination_url string, status int, redirect_chain array<{HOP}>, canonicals array<string>, failed_reason string"
FINDING = f"""rule_id string, entity_key string, severity string, state string, fact string, recommendation string,
 evidence {EVIDENCE}, suppressed boolean, config_version int, catalogue_version int"""
SUPPRESSION = "id bigint, run_id bigint, rule_id string, entity_key string, reason string, created_at bigint, revoked_at bigint"
RUN = """run_id bigint, profile string, start_url string, status string, completed boolean, cancelled boolean, error string,
 sitemap_done boolean, started_at bigint, updated_at bigint, catalogue_version int, config_version int"""

#: The domains of enumerated columns.
DOMAINS = {
    "url_state": ["fetched", "excluded", "blocked", "failed", "pending", "in_flight"],
    "sitemap_file_state": ["fetched", "inaccessible", "parse_error", "oversized", "cycle", "depth_limit", "cross_origin", "blocked", "capped"],
    "host_owner": ["same_host", "other_host", "opaque"],
    "embedded_kind": ["image", "script", "style"],
    "structured_format": ["json_ld", "microdata", "rdfa"],
    "resource_kind": ["page", "robots", "sitemap", "same_origin"],
    "run_status": ["running", "completed", "incomplete", "failed"],
    "severity": ["error", "warning", "notice"],
    "rule_state": ["passed", "findings", "incomplete", "not_applicable", "disabled", "unsupported"],
    "finding_change": ["new", "persistent", "resolved", "suppressed", "out_of_scope", "not_rechecked"],
    "host_probe_kind": ["http_homepage", "https_www", "https_apex"],
    "robots_fetch": ["fetched", "not_found", "unavailable"],
    "coverage": ["checker", "engine", "specified_unregistered", "deferred"],
    "matrix_class": ["covered", "engine_covered", "deferred_explained", "aggregate_only", "entity_overlap", "entity_miss_explained", "entity_miss_unexplained", "passing_regression_pinned"],
}
