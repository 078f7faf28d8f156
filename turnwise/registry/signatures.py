"""Signature registry: ids and the patterns that show them.

Fixed values. Rows can be added or replaced with `load`.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

CODING_AGENTS = (
    ("aider", (r"(?i)\baider\b",)),
    ("claude_code", (r"(?i)\bClaude Code\b", r"(?i)\.claude/")),
    ("claude_desktop", (r"(?i)\bClaude Desktop\b", r"(?i)local-agent-mode-sessions", r"(?i)claude-code-sessions")),
    ("claude_desktop_mcp", (r"(?i)\bClaude Desktop\b", r"(?i)Claude[/\\]mcp", r"(?i)mcp-server-")),
    ("cline", (r"\bCline\b", r"(?i)\.cline/")),
    ("codex", (r"(?i)\bCodex CLI\b", r"(?i)codex")),
    ("continue", (r"(?i)\bcontinue\.dev\b", r"\bContinue (?:IDE|extension|agent)\b", r"(?i)\.continue/")),
    ("copilot", (r"(?i)\bGitHub Copilot\b", r"(?i)\.copilot/", r"(?i)github\.copilot")),
    ("cursor", (r"\bCursor (?:IDE|rules|agent)\b", r"(?i)\.cursor/", r"(?i)cursor\.rules")),
    ("antigravity", (r"(?i)\bGoogle Antigravity\b", r"(?i)\bAntigravity IDE\b", r"(?i)\.gemini[/\\]antigravity")),
    ("gemini_cli", (r"(?i)\bGemini CLI\b",)),
    ("kiro_cli", (r"(?i)\bKiro CLI\b", r"(?i)kiro-chat\.log", r"(?i)KIRO_CHAT_LOG_FILE")),
    ("kiro_ide", (r"(?i)\bKiro\b", r"(?i)\bKiro IDE\b", r"(?i)\.kiro/", r"(?i)kiro\.kiroAgent")),
    ("opencode", (r"(?i)\bopencode\b",)),
    ("roo", (r"(?i)\bRoo Code\b", r"(?i)\.roo/")),
    ("windsurf", (r"\bWindsurf\b", r"(?i)\.windsurf/")),
)
FRAMEWORKS = (
    ("agent_sessions", (r"(?i)\bAgent Sessions\b", r"(?i)agent-sessions")),
    ("aider", (r"(?i)\baider\b", r"(?i)\.aider")),
    ("bmad", (r"(?i)\bBMAD\b", r"(?i)bmad-method")),
    ("ccusage", (r"(?i)\bccusage\b",)),
    ("claude_code_hooks", (r"(?i)\.claude/(settings|hooks)", r"(?i)Claude Code hooks?")),
    ("codex_transcript_viewer", (r"(?i)codex-transcript-viewer",)),
    ("context_engineering", (r"(?i)context engineering", r"(?i)context-engineering")),
    ("openspec", (r"(?i)\bOpenSpec\b",)),
    ("spec_kit", (r"(?i)\bSpec Kit\b", r"(?i)\bspec-kit\b")),
    ("superpowers", (r"(?i)\bsuperpowers\b", r"(?i)obra/superpowers")),
)
MCP_SERVERS = (
    ("browser", ("mcp__browser__", r"(?i)\bmcp.*browser\b")),
    ("brave_search", ("mcp__brave[_-]?search__", r"(?i)\bmcp.*brave")),
    ("context7", ("mcp__context7__", r"(?i)\bcontext7\b")),
    ("docker", ("mcp__docker__", r"(?i)\bmcp.*docker\b")),
    ("fetch", ("mcp__fetch__", r"(?i)\bmcp.*fetch\b")),
    ("figma", ("mcp__figma__", r"(?i)\bmcp.*figma\b")),
    ("filesystem", ("mcp__filesystem__", r"(?i)\bmcp.*filesystem\b")),
    ("git", ("mcp__git__", r"(?i)\bmcp.*git\b")),
    ("github", ("mcp__github__", r"(?i)\bmcp.*github\b")),
    ("gitlab", ("mcp__gitlab__", r"(?i)\bmcp.*gitlab\b")),
    ("gmail", ("mcp__gmail__", r"(?i)\bmcp.*gmail\b")),
    ("google_drive", ("mcp__google[_-]?drive__", r"(?i)\bmcp.*google drive\b")),
    ("jira", ("mcp__jira__", r"(?i)\bmcp.*jira\b")),
    ("kubernetes", ("mcp__kubernetes__", "mcp__k8s__", r"(?i)\bmcp.*kubernetes\b")),
    ("linear", ("mcp__linear__", r"(?i)\bmcp.*linear\b")),
    ("memory", ("mcp__memory__", r"(?i)\bmcp.*memory\b")),
    ("notion", ("mcp__notion__", r"(?i)\bmcp.*notion\b")),
    ("playwright", ("mcp__playwright__", r"(?i)\bmcp.*playwright\b")),
    ("postgres", ("mcp__postgres__", "mcp__postgresql__", r"(?i)\bmcp.*postgres\b")),
    ("puppeteer", ("mcp__puppeteer__", r"(?i)\bmcp.*puppeteer\b")),
    ("sentry", ("mcp__sentry__", r"(?i)\bmcp.*sentry\b")),
    ("sequential_thinking", ("mcp__sequential[_-]?thinking__", r"(?i)\bsequential thinking\b")),
    ("slack", ("mcp__slack__", r"(?i)\bmcp.*slack\b")),
    ("supabase", ("mcp__supabase__", r"(?i)\bmcp.*supabase\b")),
)
PACKAGE_MANAGERS = (
    ("bun", (r"\bbun\b", r"bun\.lockb?")),
    ("cargo", (r"\bcargo\b", r"Cargo\.toml")),
    ("composer", (r"\bcomposer\b", r"composer\.json")),
    ("go", (r"\bgo test\b", r"go\.mod")),
    ("npm", (r"\bnpm\b", r"package-lock\.json")),
    ("pip", (r"\bpip\b", r"requirements\.txt")),
    ("pnpm", (r"\bpnpm\b", r"pnpm-lock\.yaml")),
    ("poetry", (r"\bpoetry\b", r"poetry\.lock")),
    ("uv", (r"\buv\b", r"uv\.lock")),
    ("yarn", (r"\byarn\b", r"yarn\.lock")),
)
PLUGINS = (
    ("browser", (r"(?i)\bplugin.?browser\b", r"(?i)@browser")),
    ("canva", (r"(?i)\bplugin.?canva\b", r"(?i)@canva")),
    ("figma", (r"(?i)\bplugin.?figma\b", r"(?i)@figma")),
    ("github", (r"(?i)\bplugin.?github\b", r"(?i)@github")),
    ("gmail", (r"(?i)\bplugin.?gmail\b", r"(?i)@gmail")),
    ("google_calendar", (r"(?i)\bplugin.?google-calendar\b", r"(?i)@google-calendar")),
    ("google_drive", (r"(?i)\bplugin.?google-drive\b", r"(?i)@google-drive")),
    ("linear", (r"(?i)\bplugin.?linear\b", r"(?i)@linear")),
    ("notion", (r"(?i)\bplugin.?notion\b", r"(?i)@notion")),
    ("slack", (r"(?i)\bplugin.?slack\b", r"(?i)@slack")),
)
SKILLS = (
    ("ad_hoc_profile_load", (r"""(?i)(^|[\s`$"'(:/])ad-hoc-profile-load\b""",)),
    ("benchmark", (r"(?i)(^|\s)/(benchmark|gstack-benchmark)\b",)),
    ("design_review", (r"(?i)(^|\s)/(design-review|gstack-design-review)\b",)),
    ("debugger_debbie", (r"""(?i)(^|[\s`$"'(:/])debugger-debbie\b""",)),
    ("investigate", (r"(?i)(^|\s)/(investigate|gstack-investigate)\b",)),
    ("plan_ceo_review", (r"(?i)(^|\s)/(plan-ceo-review|gstack-plan-ceo-review)\b",)),
    ("plan_eng_review", (r"(?i)(^|\s)/(plan-eng-review|gstack-plan-eng-review)\b",)),
    ("qa", (r"(?i)(^|\s)/(qa|gstack-qa)\b", r"(?i)\bskill.?qa\b")),
    ("review", (r"(?i)(^|\s)/(review|gstack-review)\b", r"(?i)\bskill.?review\b")),
    ("security", (r"(?i)(^|\s)/(security|security-review|cso|gstack-cso)\b",)),
    ("ship", (r"(?i)(^|\s)/(ship|gstack-ship)\b", r"(?i)\bskill.?ship\b")),
)
CATEGORIES = {
    "coding_agent": CODING_AGENTS,
    "framework": FRAMEWORKS,
    "mcp": MCP_SERVERS,
    "skill": SKILLS,
    "plugin": PLUGINS,
    "package_manager": PACKAGE_MANAGERS,
}


def ids(category: str, categories: dict = CATEGORIES) -> tuple[str, ...]:
    return tuple(sig_id for sig_id, _ in categories[category])


def slash_command_ids(categories: dict = CATEGORIES) -> tuple[str, ...]:
    return tuple(dict.fromkeys(ids("skill", categories) + ids("framework", categories)))


def load(extra: dict[str, str]) -> dict:
    """CATEGORIES with the rows of JSON files ([{id, patterns}]) added per category."""
    out = dict(CATEGORIES)
    for category, path in extra.items():
        with open(path, encoding="utf-8") as handle:
            rows = tuple((r["id"], tuple(r["patterns"])) for r in json.load(handle))
        known = {sig_id for sig_id, _ in rows}
        out[category] = tuple(s for s in out[category] if s[0] not in known) + rows
    return out


def allow_list(spark: SparkSession, category: str, categories: dict = CATEGORIES) -> DataFrame:
    """Normalised ids as a one-column frame for semi and anti joins."""
    return spark.createDataFrame(
        [(i.lower().replace("-", "_"),) for i in ids(category, categories)], "id string"
    )
