"""URL column functions: routing, parsing, ids, tracker stripping, globs.

All are built-in regex expressions (Java regex on Spark); the patterns are
written so the same text means the same in RE2 (no lookaround, no
backreferences) and can be reused by the DuckDB oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
# Source-specific URL shapes (must match the original resolvers).
ISSUE_RE = r"^https?://(?:(?:www|m)\.)?github\.com/([^/]+)/([^/]+)/issues/(\d+)(?:[/?#].*)?$"
PR_RE = r"^https?://(?:(?:www|m)\.)?github\.com/([^/]+)/([^/]+)/pull/(\d+)(?:[/?#].*)?$"
REPO_RE = (r"^(?:https?://)?github\.com/([a-zA-Z0-9_-]+)/([a-zA-Z0-9_-]+)"
           r"(?:/(?:blob|tree|raw|commit)/([a-zA-Z0-9._-]+)/(.*))?$")
RAW_RE = r"^(?:https?://)?raw\.githubusercontent\.com/([a-zA-Z0-9_-]+)/([a-zA-Z0-9_-]+)/(.+)$"
QUESTION_RE = r"stackoverflow\.com/questions/(\d+)"
VIDEO_RE = r"(?:youtube\.com/watch\?v=|youtu\.be/|youtube\.com/embed/)([a-zA-Z0-9_-]+)"
PAGE_UUID_RE = (r"(?i)([a-f0-9]{32}|[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-"
                r"[a-f0-9]{12})")
DOI_URL_RE = r"doi\.org/(.+?)(?:$|[?#])"
DOI_PDF_RE = r"/(10\.\d{4,}[/.][\w.]+)\.pdf"
WIKI_PREFIX = "https://www.notion.so"
# Academic publishers: a URL on one of them is routed to the library only if
# the library holds it. This is the intended list (the original fused four
# names through missing commas, so three of them never matched).
ACADEMIC_DOMAINS = [
    "researchgate.net", "academia.edu", "arxiv.org", "sciencedirect.com",
    "springer.com", "ieee.org", "acm.org", "jstor.org", "nature.com",
    "wiley.com", "tandfonline.com", "sagepub.com", "oup.com", "elsevier.com",
    "apa.org", "taylorfrancis.com", "royalsocietypublishing.org",
]
# Routes in the order they are tried; the last one takes everything.
ROUTES = ["stackoverflow", "library", "video", "wiki", "issue", "pull_request", "repo", "generic"]
# Tracking parameters removed by strip_trackers ([choice]: utm_*, ref, fbclid, gclid).
TRACKER_PARAM = r"(utm_[A-Za-z0-9_]*|ref|fbclid|gclid)"
# DOI resolvers by name; default first.
DOI_RESOLVERS = {"oadoi.org": "https://oadoi.org/", "doi.org": "https://doi.org/",
                 "sci-hub.se": "https://sci-hub.se/"}
DEFAULT_DOI_RESOLVER = "oadoi.org"
# Netloc (host[:port], userinfo kept) as urlparse reports it.
NETLOC_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
# -----------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _group(c, pattern: str, idx: int) -> Column:
    """Group ``idx`` of the first match, null when the pattern does not match."""
    c = _c(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, idx))


def netloc(c) -> Column:
    return F.lower(F.regexp_extract(_c(c), NETLOC_RE, 1))


def host(c) -> Column:
    """Host without userinfo and port, lower-cased."""
    return F.regexp_extract(netloc(c), r"^(?:[^@]*@)?([^:]*)", 1)


def parse_issue_url(c) -> Column:
    """#79: struct(owner, repo, number) or null."""
    return F.when(_c(c).rlike(ISSUE_RE), F.struct(
        F.regexp_extract(_c(c), ISSUE_RE, 1).alias("owner"),
        F.regexp_extract(_c(c), ISSUE_RE, 2).alias("repo"),
        F.regexp_extract(_c(c), ISSUE_RE, 3).alias("number")))


def parse_pr_url(c) -> Column:
    return F.when(_c(c).rlike(PR_RE), F.struct(
        F.regexp_extract(_c(c), PR_RE, 1).alias("owner"),
        F.regexp_extract(_c(c), PR_RE, 2).alias("repo"),
        F.regexp_extract(_c(c), PR_RE, 3).alias("number")))


def parse_repo_url(c) -> Column:
    """#77/#78: struct(owner, repository, branch_or_commit, path) or null.

    Repo URLs leave branch/path null when absent; raw-host URLs take the first
    path segment as branch (three when it starts with ``refs`` and there are at
    least three), the rest as path ('' allowed).
    """
    u = _c(c)
    repo = F.struct(
        F.regexp_extract(u, REPO_RE, 1).alias("owner"),
        F.regexp_extract(u, REPO_RE, 2).alias("repository"),
        F.nullif(F.regexp_extract(u, REPO_RE, 3), F.lit("")).alias("branch_or_commit"),
        F.nullif(F.regexp_extract(u, REPO_RE, 4), F.lit("")).alias("path"))
    rest = F.split(F.regexp_extract(u, RAW_RE, 3), "/")
    refs = (F.size(rest) >= 3) & (F.element_at(rest, 1) == "refs")
    raw = F.struct(
        F.regexp_extract(u, RAW_RE, 1).alias("owner"),
        F.regexp_extract(u, RAW_RE, 2).alias("repository"),
        F.when(refs, F.array_join(F.slice(rest, 1, 3), "/")).otherwise(F.element_at(rest, 1))
         .alias("branch_or_commit"),
        F.when(refs, F.array_join(F.slice(rest, 4, 1 << 30), "/"))
         .otherwise(F.array_join(F.slice(rest, 2, 1 << 30), "/")).alias("path"))
    return F.when(u.rlike(REPO_RE), repo).when(u.rlike(RAW_RE), raw)


def question_id(c) -> Column:
    """#80: digits after /questions/ as bigint."""
    return _group(c, QUESTION_RE, 1).cast("long")


def video_id(c) -> Column:
    """#81: id after watch?v= / youtu.be/ / embed/."""
    return _group(c, VIDEO_RE, 1)


def page_uuid(c) -> Column:
    """#82: first 32-hex or dashed UUID, dashes removed, case kept."""
    return F.replace(_group(c, PAGE_UUID_RE, 1), F.lit("-"), F.lit(""))


def extract_doi(c) -> Column:
    """#83: after doi.org/ up to ?/#/end; else 10.NNNN/... before .pdf."""
    return F.coalesce(_group(c, DOI_URL_RE, 1), _group(c, DOI_PDF_RE, 1))


def is_academic(c) -> Column:
    u = _c(c)
    cond = F.lit(False)
    for d in ACADEMIC_DOMAINS:
        cond = cond | u.contains(d)
    return cond


def route_url(c, library_held: Column | None = None, library_enabled: bool = True,
              wiki_enabled: bool = True) -> Column:
    """#75: first matching route in ``ROUTES`` order.

    ``library_held``: boolean column, true when the library holds this URL
    (from a semi join against the item table); academic URLs route to the
    library only then. Substring tests for the first three kinds.
    """
    u = _c(c)
    held = F.lit(False) if library_held is None else F.coalesce(library_held, F.lit(False))
    lib = F.lit(library_enabled) & (u.contains("doi.org") | (is_academic(u) & held))
    wiki = F.lit(wiki_enabled) & u.startswith(WIKI_PREFIX) & page_uuid(u).isNotNull()
    return (F.when(u.contains("stackoverflow.com/questions"), F.lit("stackoverflow"))
             .when(lib, F.lit("library"))
             .when(u.contains("youtube.com") | u.contains("youtu.be"), F.lit("video"))
             .when(wiki, F.lit("wiki"))
             .when(u.rlike(ISSUE_RE), F.lit("issue"))
             .when(u.rlike(PR_RE), F.lit("pull_request"))
             .when(u.rlike(REPO_RE) | u.rlike(RAW_RE), F.lit("repo"))
             .otherwise(F.lit("generic")))


def strip_trackers(c) -> Column:
    """#85: drop tracking query parameters; an emptied query loses its '?'."""
    u = _c(c)
    base = F.regexp_extract(u, r"^([^?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    frag = F.regexp_extract(u, r"(#.*)$", 1)
    keep = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^" + TRACKER_PARAM + "(=|$)"))
    return F.concat(base, F.when(F.size(keep) > 0, F.concat(F.lit("?"), F.array_join(keep, "&")))
                    .otherwise(F.lit("")), frag)


def rewrite_doi_url(doi: Column, resolver: str = DEFAULT_DOI_RESOLVER) -> Column:
    """#86: DOI -> resolver URL (unknown resolver names use the default)."""
    base = DOI_RESOLVERS.get(resolver, DOI_RESOLVERS[DEFAULT_DOI_RESOLVER])
    return F.when(doi.isNotNull(), F.concat(F.lit(base), doi))


def glob_regex(glob: str) -> str:
    """Shell glob -> anchored, case-insensitive, dot-all regex (``*`` crosses '/')."""
    out, i, n = [], 0, len(glob)
    while i < n:
        ch = glob[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            j = i
            if j < n and glob[j] == "!":
                j += 1
            if j < n and glob[j] == "]":
                j += 1
            while j < n and glob[j] != "]":
                j += 1
            if j >= n:
                out.append("\\[")
            else:
                body = glob[i:j].replace("\\", "\\\\")
                i = j + 1
                if body.startswith("!"):
                    body = "^" + body[1:]
                elif body.startswith("^"):
                    body = "\\" + body
                out.append("[" + body + "]")
        else:
            out.append(re.escape(ch) if not ch.isalnum() else ch)
    return "(?is)^" + "".join(out) + "$"


def glob_match(c, glob: str) -> Column:
    """#24: case-insensitive shell glob on the whole value."""
    return F.lower(_c(c)).rlike(glob_regex(glob.lower()))


def url_ok(c) -> Column:
    """http/https with a host."""
    return _c(c).rlike(r"^(?i:https?)://[^/?#]+")
