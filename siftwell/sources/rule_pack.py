"""Rule packs that a user supplies: JSON, optionally signed, without what the catalogue has already."""

from __future__ import annotations

import hashlib
import hmac
import json
import re

from siftwell.functions.catalog import RULES, Rule
from siftwell.functions.dialect import to_java

# Category slug, provider, category.
CATEGORIES = {
    slug: (provider, category)
    for slug, provider, category in (
        ("secrets-aws", "AWS", "Cloud Credentials"), ("secrets-gcp", "Google Cloud", "Cloud Credentials"), ("secrets-azure", "Azure", "Cloud Credentials"),
        ("secrets-cloud", "Cloud", "Cloud Credentials"), ("secrets-github", "GitHub", "Authentication Tokens"), ("secrets-gitlab", "GitLab", "Authentication Tokens"),
        ("secrets-vcs", "VCS", "Authentication Tokens"), ("secrets-databases", "Database", "Database Credentials"), ("secrets-database", "Database", "Database Credentials"),
        ("secrets-private-keys", "Private Key", "Private Keys"), ("secrets-stripe", "Stripe", "API Keys"), ("secrets-cicd", "CI/CD", "Infrastructure"),
        ("secrets-infrastructure", "Infrastructure", "Infrastructure"), ("pii-us", "PII", "PII"), ("code-injection", "Code", "Code Injection"),
        ("secrets-email", "Email", "SaaS Tokens"), ("secrets-misconfig", "Generic", "Misconfiguration"), ("secrets-comments", "Generic", "Generic Secrets"),
        ("secrets-encoding", "Generic", "Encoding"), ("secrets-twilio", "Twilio", "SaaS Tokens"), ("secrets-mailgun", "Mailgun", "SaaS Tokens"),
        ("secrets-slack", "Slack", "SaaS Tokens"), ("secrets-discord", "Discord", "SaaS Tokens"), ("secrets-telegram", "Telegram", "SaaS Tokens"),
        ("secrets-pagerduty", "PagerDuty", "SaaS Tokens"), ("secrets-datadog", "Datadog", "SaaS Tokens"), ("secrets-newrelic", "New Relic", "SaaS Tokens"),
        ("secrets-sentry", "Sentry", "SaaS Tokens"), ("secrets-saas", "SaaS", "SaaS Tokens"), ("secrets-ai", "AI/ML", "AI/ML Keys"),
        ("secrets-registry", "Registry", "Registry Tokens"), ("secrets-token", "Generic", "Authentication Tokens"), ("secrets-generic", "Generic", "Generic Secrets"),
    )
}


def title(slug: str) -> str:
    return " ".join(x[:1].upper() + x[1:] for x in re.split("[-_]", slug))


def load(text: str, signature: str | None = None, key: bytes | None = None) -> tuple[tuple[Rule, ...], list[str]]:
    """Rules of a pack and warnings. Without a signature it loads with a warning; with a bad one it doesn't."""
    warnings = []
    if signature is None:
        warnings.append("the pack is not signed")
    elif not hmac.compare_digest(hmac.new(key or b"", text.encode(), hashlib.sha256).hexdigest(), signature.strip()):
        return (), ["the pack's signature is wrong"]
    ids, patterns, out = {r.id for r in RULES}, {r.pattern.lower() for r in RULES if r.pattern}, []
    for row in json.loads(text):
        if row.get("id") in ids or str(row.get("pattern", "")).lower() in patterns:
            continue
        try:
            java, groups = to_java(row["pattern"]), re.compile(row["pattern"]).groups
        except (KeyError, ValueError) as e:
            warnings.append(f"{row.get('id', '?')}: {e}")
            continue
        slug = row.get("category", "")
        provider, category = CATEGORIES.get(slug, (title(slug.removeprefix("secrets-")), title(slug)))
        out.append(Rule(500 + len(out), row["id"], row.get("name", row["id"]), row.get("severity", "medium"), provider, category, "-", min(1, groups), row["pattern"], "pack", row.get("confidence"), java))
    return tuple(out), warnings
