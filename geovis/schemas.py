"""Column types and allowed values of the stored tables."""

from __future__ import annotations

from geovis.functions.money import PROVIDERS
from geovis.operators.checks.registry import CATEGORIES
from geovis.operators.contracts import PRIORITIES, QUERY_CATEGORIES, SENTIMENTS
from geovis.sources.sinks import AUDIT_STATES

CHECK = (
    "struct<check_no:int,check_id:string,label:string,status:string,points_earned:int,points_max:int,"
    "evidence:string,recommendation:string>"
)

TABLES = {
    "profiles": "id string, email string, role string, full_name string, created_at timestamp, updated_at timestamp",
    "audits": (
        "id string, user_id string, url string, url_normalized string, language string, status string, progress short, "
        "current_step string, error_message string, manual_competitors array<string>, geo_target string, "
        "created_at timestamp, updated_at timestamp, completed_at timestamp"
    ),
    "audit_business_info": (
        "audit_id string, brand_name string, brand_aliases array<string>, industry string, services array<string>, "
        "geo_zone string, detected_competitors array<string>, raw_extraction variant, created_at timestamp"
    ),
    "audit_technical": f"audit_id string, category string, checks array<{CHECK}>, score short, created_at timestamp",
    "queries": "id string, audit_id string, text string, category string, position short, created_at timestamp",
    "ai_responses": (
        "id string, query_id string, provider string, model string, raw_response string, "
        "sources array<struct<url:string,title:string>>, tokens_in int, tokens_out int, cost_usd decimal(10,6), "
        "latency_ms int, error_message string, created_at timestamp"
    ),
    "ai_response_analysis": (
        "response_id string, brand_mentioned boolean, mention_position short, mention_context string, "
        "brand_citation_present boolean, sentiment string, competitors_cited array<string>, sources_cited array<string>, "
        "raw_analysis variant, analyzed_at timestamp"
    ),
    "audit_scores": (
        "audit_id string, technical_score short, visibility_score short, global_score short, "
        "visibility_per_provider map<string,int>, mention_rate decimal(5,2), citation_rate decimal(5,2), "
        "top_competitor string, computed_at timestamp"
    ),
    "audit_recommendations": (
        "id string, audit_id string, priority string, category string, title string, description string, "
        "impact_score short, position short, created_at timestamp"
    ),
    "api_usage": (
        "id string, user_id string, audit_id string, provider string, model string, tokens_in int, tokens_out int, "
        "cost_usd decimal(10,6), cost_eur decimal(10,6), request_type string, created_at timestamp"
    ),
    "email_captures": (
        "id string, audit_id string, email string, source string, ip_address string, user_agent string, created_at timestamp"
    ),
    "rate_limits": "id string, ip_address string, action string, audit_id string, created_at timestamp",
}

ALLOWED = {
    ("profiles", "role"): ["admin", "client"],
    ("audits", "status"): AUDIT_STATES,
    ("audit_technical", "category"): CATEGORIES,
    ("queries", "category"): QUERY_CATEGORIES,
    ("ai_responses", "provider"): PROVIDERS,
    ("ai_response_analysis", "sentiment"): SENTIMENTS,
    ("audit_recommendations", "priority"): PRIORITIES,
}

RANGES = {
    ("audits", "progress"): (0, 100),
    ("audit_technical", "score"): (0, 20),
    ("audit_scores", "technical_score"): (0, 100),
    ("audit_scores", "visibility_score"): (0, 100),
    ("audit_scores", "global_score"): (0, 100),
    ("audit_recommendations", "impact_score"): (1, 10),
}

UNIQUE = {
    "profiles": ["email"],
    "audit_technical": ["audit_id", "category"],
    "ai_responses": ["query_id", "provider"],
}

# A column and the table whose key it holds; null where it may be.
PARENTS = {
    ("audits", "user_id"): ("profiles", "id"),
    ("audit_business_info", "audit_id"): ("audits", "id"),
    ("audit_technical", "audit_id"): ("audits", "id"),
    ("queries", "audit_id"): ("audits", "id"),
    ("ai_responses", "query_id"): ("queries", "id"),
    ("ai_response_analysis", "response_id"): ("ai_responses", "id"),
    ("audit_scores", "audit_id"): ("audits", "id"),
    ("audit_recommendations", "audit_id"): ("audits", "id"),
    ("api_usage", "user_id"): ("profiles", "id"),
    ("api_usage", "audit_id"): ("audits", "id"),
    ("email_captures", "audit_id"): ("audits", "id"),
    ("rate_limits", "audit_id"): ("audits", "id"),
}
