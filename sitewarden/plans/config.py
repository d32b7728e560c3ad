"""Audit configuration: enabled rules, thresholds as strings, and the profile of a site."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

VERSION = 1

#: Thresholds and their defaults; a value that can't be read falls back to the default.
DEFAULTS: dict[str, int | float | str] = {
    "max_title_chars": 60, "min_title_chars": 30, "max_html_bytes": 1_048_576,
    "max_on_page_links": 2500, "max_query_params": 4, "max_link_chars": 2048, "max_url_chars": 200, "max_redirects": 1,
    "generic_anchor_list": "click here,click,here,more,read more,learn more,this,link,continue",
    "max_sitemap_urls": 50_000, "max_clicks": 3,
    "min_language_hits": 8, "min_language_confidence": 0.6,
    "near_duplicate_max_hamming": 3, "boilerplate_min_pages": 3, "min_main_tokens": 12,
    "days_before_expiry": 14,
}


@dataclass(frozen=True)
class AuditConfig:
    version: int = VERSION
    enabled: dict[str, bool] = field(default_factory=dict)
    thresholds: dict[str, str] = field(default_factory=dict)

    def is_enabled(self, rule_id: str) -> bool:
        return self.enabled.get(rule_id, True)

    def number(self, key: str) -> int | float:
        default = DEFAULTS[key]
        try:
            value = type(default)(self.thresholds[key].strip())
        except (KeyError, ValueError):
            return default
        return value if value >= 0 else default

    def text(self, key: str, default: str | None = None) -> str | None:
        return self.thresholds.get(key, DEFAULTS.get(key, default))

    def fingerprint(self) -> str:
        enabled = ",".join(f"{k}={int(v)}" for k, v in sorted(self.enabled.items()))
        thresholds = ",".join(f"{k}={v}" for k, v in sorted(self.thresholds.items()))
        return f"v{self.version};e:{enabled};t:{thresholds}"


@dataclass(frozen=True)
class Profile:
    """What a crawl covers. Unknown keys and impossible values are refused."""

    name: str
    start_url: str
    allowed_subfolders: tuple[str, ...] = ()
    excluded_paths: tuple[str, ...] = ()
    ignored_parameters: tuple[str, ...] = ()
    ignored_parameter_mode: str = "skip"
    case_sensitive_parameters: bool = True
    discovery: str = "combined"
    max_pages: int = 20_000
    max_queue: int = 1024
    user_agent: str = "sitewarden"
    timezone: str = "UTC"

    def __post_init__(self):
        if not self.name.strip():
            raise ValueError("a profile needs a name")
        if not self.start_url.startswith(("http://", "https://")):
            raise ValueError("start_url must be an http or https URL")
        if self.ignored_parameter_mode not in ("skip", "strip"):
            raise ValueError("ignored_parameter_mode is skip or strip")
        if self.discovery not in ("homepage_internal_links", "sitemap", "combined"):
            raise ValueError("discovery is homepage_internal_links, sitemap or combined")
        if self.max_pages < 1 or self.max_queue < 1:
            raise ValueError("limits must be positive")
        if any(not p.startswith("/") for p in (*self.allowed_subfolders, *self.excluded_paths)):
            raise ValueError("paths must begin with a slash")
        from zoneinfo import ZoneInfo

        ZoneInfo(self.timezone)

    @classmethod
    def read(cls, text: str) -> Profile:
        raw = tomllib.loads(text)
        if unknown := set(raw) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
