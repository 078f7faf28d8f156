"""Request and e-mail columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path prefixes and the templates they are reported as, in test order.
PATH_TEMPLATES = (
    ("/api/uploads/", "/api/uploads/:id"),
    ("/api/paid-uploads/", "/api/paid-uploads/:id"),
    ("/api/public-reports/", "/api/public-reports/:id/:token"),
    ("/api/public-artifacts/", "/api/public-artifacts/:id/:token/plugin.zip"),
    ("/api/email-unlocks", "/api/email-unlocks"),
    ("/api/report-deliveries", "/api/report-deliveries"),
    ("/api/analytics/cta-copy/", "/api/analytics/cta-copy/:id"),
    ("/api/full-scan-client-reports", "/api/full-scan-client-reports"),
    ("/api/admin/email-unlocks", "/api/admin/email-unlocks"),
    ("/email/confirm/", "/email/confirm/:id/:token"),
    ("/api/jobs/", "/api/jobs/:id"),
    ("/r/", "/r/:id/:token"),
)
CTA_PREFIX = "/api/analytics/cta-copy/"
CTA_IDS = (
    "npx_landing_hero",
    "npx_landing_final",
    "npx_privacy",
    "npx_security",
    "npx_proof_index",
    "npx_proof_methodology",
    "npx_proof_results",
    "npx_proof_benchmark_comparison",
)
UTM_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term")
BOT_MARKERS = (
    "bot", "crawler", "spider", "slurp", "ahrefs", "semrush", "bytespider",
    "facebookexternalhit",
)


def cta_id(path: Column) -> Column:
    """Id after the call-to-action prefix; NULL on other paths."""
    return F.when(path.startswith(CTA_PREFIX), F.substr(path, F.lit(len(CTA_PREFIX) + 1)))


def known_cta(path: Column) -> Column:
    return F.coalesce(cta_id(path).isin(*CTA_IDS), F.lit(False))


def path_template(path: Column, templates=PATH_TEMPLATES) -> Column:
    out = F.when(known_cta(path), path)
    for prefix, template in templates:
        out = out.when(path.startswith(prefix), F.lit(template))
    return out.otherwise(path)


def auth_surface(path: Column) -> Column:
    def under(*prefixes):
        test = path.startswith(prefixes[0])
        for prefix in prefixes[1:]:
            test = test | path.startswith(prefix)
        return test

    return (
        F.when(
            path.isin("/api/admin/usage-stats", "/api/admin/email-unlocks"), "admin_token"
        )
        .when(under("/api/uploads/", "/api/paid-uploads/"), "upload_token")
        .when(under("/api/public-reports/", "/api/public-artifacts/", "/r/"), "report_token")
        .when(under("/email/confirm/"), "email_confirmation_token")
        .otherwise("none")
    )


def authenticated(surface: Column, status: Column) -> Column:
    return (surface != "none") & (status < 400)


def first_client_ip(forwarded: Column, real_ip: Column, remote: Column) -> Column:
    hops = F.filter(F.transform(F.split(forwarded, ","), lambda p: F.trim(p)), lambda p: p != "")
    port = r":\d+$"
    return F.coalesce(
        F.try_element_at(hops, F.lit(1)),
        F.nullif(F.trim(real_ip), F.lit("")),
        F.regexp_replace(F.regexp_replace(F.trim(remote), port, ""), r"^\[|\]$", ""),
    )


def client_hash(salt: str, ip: Column) -> Column:
    if not salt:
        return F.lit("")
    return F.when(F.coalesce(ip, F.lit("")) == "", "").otherwise(
        F.sha2(F.concat(F.lit(salt), F.char(F.lit(0)), ip), 256)
    )


def _ipv6_prefix(ip: Column) -> Column:
    """The first three groups as a /48 network in short form; '' for what is no IPv6 address."""
    text = F.lower(ip)
    dotted = F.regexp_extract(text, r"[^:]*\.[^:]*$", 0)
    # A dotted tail stands for the last two groups, which the prefix does not show.
    text = F.when(_is_ipv4(dotted), F.regexp_replace(text, r"[^:]*\.[^:]*$", "0:0")).otherwise(text)
    halves = F.split(text, "::")

    def groups(half: Column) -> Column:
        return F.when(F.coalesce(half, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    left, right = groups(F.get(halves, 0)), groups(F.get(halves, 1))
    given = F.size(left) + F.size(right)
    fits = ((F.size(halves) == 1) & (given == 8)) | ((F.size(halves) == 2) & (given <= 7))
    ok = fits & F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0))), right)
    plain = F.transform(F.slice(whole, 1, 3), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
    short = F.regexp_replace(F.array_join(plain, ":"), "(^|:)0(:0)*$", "")
    return F.when(ip.isNotNull(), F.when(ok, F.concat(short, F.lit("::/48"))).otherwise(""))


IPV4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def _is_ipv4(ip: Column) -> Column:
    octets = [F.try_to_number(F.regexp_extract(ip, IPV4, i), F.lit("999")) for i in range(1, 5)]
    ok = ip.rlike(IPV4) & ~ip.rlike(r"(^|\.)0\d")
    for octet in octets:
        ok = ok & (octet <= 255)
    return F.coalesce(ok, F.lit(False))


def ip_version(ip: Column) -> Column:
    return (
        F.when(_is_ipv4(ip), "ipv4")
        .when(ip.contains(":") & (_ipv6_only(ip) != ""), "ipv6")
        .otherwise("")
    )


def _ipv6_only(ip: Column) -> Column:
    # NULL for everything else, so Python sees real work only for ':' rows.
    return _ipv6_prefix(F.when(ip.contains(":"), ip))


def ip_prefix(ip: Column) -> Column:
    return (
        F.when(_is_ipv4(ip), F.concat(F.regexp_replace(ip, r"\d+$", "0"), F.lit("/24")))
        .when(ip.contains(":"), F.coalesce(_ipv6_only(ip), F.lit("")))
        .otherwise("")
    )


def user_agent_family(agent: Column) -> Column:
    ua = F.lower(agent)
    return (
        F.when(ua == "", "unknown")
        .when(ua.contains("curl/"), "curl")
        .when(ua.contains("npm/") | ua.contains("node"), "node")
        .when(ua.contains("python-requests"), "python-requests")
        .when(ua.contains("go-http-client"), "go-http-client")
        .when(ua.contains("mozilla/"), "browser")
        .otherwise("other")
    )


def _browser_rules(ua: Column):
    return (
        ("edge", ua.contains("edg/"), "edg/"),
        ("firefox", ua.contains("firefox/"), "firefox/"),
        ("firefox", ua.contains("fxios/"), "fxios/"),
        ("chrome", ua.contains("crios/"), "crios/"),
        ("chrome", ua.contains("chrome/"), "chrome/"),
        ("safari", ua.contains("safari/") & ua.contains("version/"), "version/"),
        ("curl", ua.contains("curl/"), "curl/"),
        ("node", ua.contains("npm/"), "npm/"),
        ("node", ua.contains("node"), None),
        ("python-requests", ua.contains("python-requests/"), "python-requests/"),
        ("go-http-client", ua.contains("go-http-client/"), "go-http-client/"),
    )


def _first_match(rules, default: str) -> Column:
    out = None
    for test, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)


def browser(agent: Column) -> Column:
    return _first_match(
        [(test, name) for name, test, _ in _browser_rules(F.lower(agent))], "unknown"
    )


def browser_major(agent: Column) -> Column:
    ua = F.lower(agent)
    return _first_match(
        [
            (test, F.lit("") if mark is None else F.regexp_extract(ua, mark + r"(\d*)", 1))
            for _, test, mark in _browser_rules(ua)
        ],
        "",
    )


def operating_system(agent: Column) -> Column:
    ua = F.lower(agent)
    return (
        F.when(ua.contains("iphone os ") | ua.contains("cpu os "), "ios")
        .when(ua.contains("android "), "android")
        .when(ua.contains("mac os x "), "macos")
        .when(ua.contains("windows nt "), "windows")
        .when(ua.contains("linux"), "linux")
        .otherwise("unknown")
    )


def os_major(agent: Column) -> Column:
    kind = operating_system(agent)
    return (
        F.when(kind == "ios", F.regexp_extract(agent, r"(?:iPhone OS|CPU OS) ([0-9]+)", 1))
        .when(kind == "android", F.regexp_extract(agent, r"Android ([0-9]+)", 1))
        .when(kind == "macos", F.regexp_extract(agent, r"Mac OS X ([0-9]+)", 1))
        .when(kind == "windows", F.regexp_extract(agent, r"Windows NT ([0-9]+)", 1))
        .otherwise("")
    )


def is_bot(agent: Column) -> Column:
    return F.lower(agent).rlike("|".join(BOT_MARKERS))


def device_class(agent: Column) -> Column:
    ua = F.lower(agent)
    name = browser(agent)
    return (
        F.when(ua == "", "unknown")
        .when(is_bot(agent), "bot")
        .when(ua.contains("ipad") | ua.contains("tablet"), "tablet")
        .when(ua.contains("mobile") | ua.contains("iphone") | ua.contains("android"), "mobile")
        .when(name.isin("curl", "node", "python-requests", "go-http-client"), "automation")
        .when(name == "unknown", "unknown")
        .otherwise("desktop")
    )


def _language_parts(header: Column) -> Column:
    first = F.trim(F.element_at(F.split(F.trim(header), ","), 1))
    first = F.trim(F.element_at(F.split(first, ";"), 1))
    return F.split(F.translate(first, "_", "-"), "-")


def language(header: Column) -> Column:
    return F.lower(F.element_at(_language_parts(header), 1))


def region(header: Column) -> Column:
    return F.coalesce(F.upper(F.try_element_at(_language_parts(header), F.lit(2))), F.lit(""))


def clean_host(host: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.trim(host)), r":\d+$", ""), 1, 120)


def url_part(url: Column, part: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit(part)), F.lit(""))


def referrer_host(url: Column) -> Column:
    return clean_host(url_part(F.trim(url), "HOST"))


def referrer_internal(url: Column, request_host: Column) -> Column:
    host = referrer_host(url)
    return (host != "") & (host == request_host)


def referrer_path(url: Column, request_host: Column) -> Column:
    """Templated path of an internal referrer; '' for others."""
    return F.when(
        referrer_internal(url, request_host), path_template(url_part(F.trim(url), "PATH"))
    ).otherwise("")


def request_scheme(forwarded_proto: Column, tls: Column, url: Column) -> Column:
    proto = F.lower(F.trim(F.coalesce(forwarded_proto, F.lit(""))))
    scheme = F.lower(url_part(url, "PROTOCOL"))
    return (
        F.when(proto.isin("http", "https"), proto)
        .when(tls, "https")
        .when(scheme.isin("http", "https"), scheme)
        .otherwise("http")
    )


def cut_bytes(value: Column, limit: int) -> Column:
    """At most `limit` bytes, kept whole where it is one-byte text."""
    cut = F.decode(F.substring(F.encode(value, "UTF-8"), 1, limit), "UTF-8")
    return F.when(F.octet_length(value) <= limit, value).otherwise(cut)


def utm(url: Column) -> Column:
    """Map of the five campaign keys that carry a value; NULL when none does."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(key).alias("key"),
                cut_bytes(
                    F.trim(
                        F.coalesce(
                            F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(key))),
                            F.lit(""),
                        )
                    ),
                    120,
                ).alias("value"),
            )
            for key in UTM_KEYS
        ]
    )
    full = F.map_from_entries(F.filter(pairs, lambda p: p["value"] != ""))
    return F.when(F.size(full) > 0, full)


def normalize_email(email: Column) -> Column:
    return F.lower(F.trim(F.coalesce(email, F.lit(""))))


def hash_email(email: Column) -> Column:
    return F.sha2(normalize_email(email), 256)


def email_domain(email: Column) -> Column:
    return F.substring_index(normalize_email(email), "@", -1)


def mask_email(email: Column) -> Column:
    address = normalize_email(email)
    local = F.substring_index(address, "@", 1)
    domain = F.substr(address, F.locate("@", address) + 1)
    masked = (
        F.when(F.length(local) <= 1, F.lit("*"))
        .when(F.length(local) == 2, F.concat(F.substring(local, 1, 1), F.lit("*")))
        .otherwise(F.concat(F.substring(local, 1, 1), F.lit("***"), F.right(local, F.lit(1))))
    )
    return (
        F.when(address == "", "unknown")
        .when(~address.contains("@"), address)
        .otherwise(F.concat(masked, F.lit("@"), domain))
    )


def is_owner_email(email: Column, own_emails, own_domains) -> Column:
    address = normalize_email(email)
    by_domain = address.contains("@") & email_domain(email).isin(*own_domains or [""])
    return address.isin(*own_emails or [""]) & (address != "") | by_domain
