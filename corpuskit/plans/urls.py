"""URL operators over the page-derived URL table (#2, #13, #18, #24, #64-65,
#75-86). Every page yields every URL shape (``sources.fixtures.URL_FORMS``),
so the work grows with ``pages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import mime as M
from corpuskit.functions import urls as U
from corpuskit.operators import items as I
from corpuskit.operators.activity import numbered
from corpuskit.operators.retrieval import small
from corpuskit.plans.registry import register
from corpuskit.plans.sqlparts import group_sql, held_cte, rx, sql_list, sql_str
from corpuskit.session import materialize
from corpuskit.sources import fixtures as X
from corpuskit.tables import Tables

CASES = X.url_cases_sql()
HELD_SQL = f"{X.items_sql()}, {held_cte('url_cases')}"


def _academic_sql(u: str) -> str:
    return "(" + " OR ".join(f"contains({u}, {sql_str(d)})" for d in U.ACADEMIC_DOMAINS) + ")"


def route_sql(u: str, held: str) -> str:
    uuid = group_sql(u, U.PAGE_UUID_RE, 1)
    return f"""(CASE
  WHEN contains({u}, 'stackoverflow.com/questions') THEN 'stackoverflow'
  WHEN contains({u}, 'doi.org') OR ({_academic_sql(u)} AND coalesce({held}, false)) THEN 'library'
  WHEN contains({u}, 'youtube.com') OR contains({u}, 'youtu.be') THEN 'video'
  WHEN starts_with({u}, {sql_str(U.WIKI_PREFIX)}) AND {uuid} IS NOT NULL THEN 'wiki'
  WHEN {rx(u, U.ISSUE_RE)} THEN 'issue'
  WHEN {rx(u, U.PR_RE)} THEN 'pull_request'
  WHEN {rx(u, U.REPO_RE)} OR {rx(u, U.RAW_RE)} THEN 'repo'
  ELSE 'generic' END)"""


def routed(t: Tables) -> DataFrame:
    cases = X.url_cases(t)
    held = I.held_urls(cases.filter(U.is_academic("url")), X.items(t))  # other hosts do not ask the library
    return cases.join(held, "url", "left").select("page_id", "kind", "url", U.route_url("url", F.col("held")).alias("route"))


@register("route_url", sql=f"""
WITH {CASES}, {HELD_SQL}
SELECT page_id, kind, url, {route_sql('url', 'h.held')} AS route
FROM url_cases LEFT JOIN _held h USING (url)""")
def q_route_url(t: Tables) -> DataFrame:
    """#75: first matching handler, library only for held academic URLs."""
    return routed(t)


@register("group_by_route", sql=f"""
WITH {CASES}, {HELD_SQL},
r AS (SELECT page_id, kind, url, {route_sql('url', 'h.held')} AS route FROM url_cases LEFT JOIN _held h USING (url))
SELECT route, count(*) AS n_urls, arg_min(url, (page_id, kind)) AS first_url,
       arg_max(url, (page_id, kind)) AS last_url
FROM r GROUP BY route""")
def q_group_by_route(t: Tables) -> DataFrame:
    """#76: URLs per handler, input order kept via (page_id, kind).

    Summarised with partial aggregates (count, first, last) so a handler that
    receives most URLs never becomes one huge group.
    """
    order = F.struct("page_id", "kind")
    return (routed(t).groupBy("route")
            .agg(F.count(F.lit(1)).alias("n_urls"), F.min_by("url", order).alias("first_url"),
                 F.max_by("url", order).alias("last_url")))


@register("route_queues", sql=f"""
WITH {CASES}, {HELD_SQL},
r AS (SELECT page_id, kind, url, {route_sql('url', 'h.held')} AS route FROM url_cases LEFT JOIN _held h USING (url))
SELECT route, row_number() OVER (PARTITION BY route ORDER BY page_id, kind) AS pos, page_id, kind, url FROM r""")
def q_route_queues(t: Tables) -> DataFrame:
    """#76: every URL with its place in its handler's list (input order kept).

    One row a URL, so a handler's failing URL costs that row alone, and the
    handler of most URLs is worked on by many tasks.
    """
    r = numbered(routed(t), ["route"], [F.floor(F.col("page_id") / 256)], ["page_id", "kind"])
    return r.select("route", "pos", "page_id", "kind", "url")


@register("parse_repo_url", sql=f"""
WITH {CASES}
SELECT page_id, kind,
  CASE WHEN {rx('url', U.REPO_RE)} THEN regexp_extract(url, {sql_str(U.REPO_RE)}, 1) END AS owner,
  CASE WHEN {rx('url', U.REPO_RE)} THEN regexp_extract(url, {sql_str(U.REPO_RE)}, 2) END AS repository,
  CASE WHEN {rx('url', U.REPO_RE)} THEN nullif(regexp_extract(url, {sql_str(U.REPO_RE)}, 3), '') END AS branch_or_commit,
  CASE WHEN {rx('url', U.REPO_RE)} THEN nullif(regexp_extract(url, {sql_str(U.REPO_RE)}, 4), '') END AS path
FROM url_cases""")
def q_parse_repo_url(t: Tables) -> DataFrame:
    """#77: owner / repository / branch / path of github.com URLs."""
    p = U.parse_repo_url(F.when(F.col("url").rlike(U.REPO_RE), F.col("url")))
    return X.url_cases(t).select("page_id", "kind", p.owner.alias("owner"), p.repository.alias("repository"),
                                 p.branch_or_commit.alias("branch_or_commit"), p.path.alias("path"))


_REST = f"string_split(regexp_extract(url, {sql_str(U.RAW_RE)}, 3), '/')"


@register("parse_raw_url", sql=f"""
WITH {CASES},
r AS (SELECT page_id, kind, url, {_REST} AS rest, {rx('url', U.RAW_RE)} AS ok FROM url_cases)
SELECT page_id, kind,
  CASE WHEN ok THEN regexp_extract(url, {sql_str(U.RAW_RE)}, 1) END AS owner,
  CASE WHEN ok THEN regexp_extract(url, {sql_str(U.RAW_RE)}, 2) END AS repository,
  CASE WHEN ok THEN (CASE WHEN len(rest) >= 3 AND rest[1] = 'refs' THEN array_to_string(rest[1:3], '/')
                          ELSE rest[1] END) END AS branch_or_commit,
  CASE WHEN ok THEN (CASE WHEN len(rest) >= 3 AND rest[1] = 'refs' THEN array_to_string(rest[4:], '/')
                          ELSE array_to_string(rest[2:], '/') END) END AS path
FROM r""")
def q_parse_raw_url(t: Tables) -> DataFrame:
    """#78: raw-host URLs: branch = first segment (three for refs/...), rest = path."""
    u = F.col("url")
    p = U.parse_repo_url(F.when(~u.rlike(U.REPO_RE) & u.rlike(U.RAW_RE), u))
    return X.url_cases(t).select("page_id", "kind", p.owner.alias("owner"), p.repository.alias("repository"),
                                 p.branch_or_commit.alias("branch_or_commit"), p.path.alias("path"))


def _triple_sql(pat: str, names: tuple[str, str, str]) -> str:
    return ", ".join(f"{group_sql('url', pat, i + 1)} AS {n}" for i, n in enumerate(names))


@register("parse_issue_url", sql=f"""
WITH {CASES}
SELECT page_id, kind, {_triple_sql(U.ISSUE_RE, ('issue_owner', 'issue_repo', 'issue_number'))},
       {_triple_sql(U.PR_RE, ('pr_owner', 'pr_repo', 'pr_number'))}
FROM url_cases""")
def q_parse_issue_url(t: Tables) -> DataFrame:
    """#79: issue and pull-request URLs -> owner, repo, number."""
    i, p = U.parse_issue_url("url"), U.parse_pr_url("url")
    return X.url_cases(t).select(
        "page_id", "kind", i.owner.alias("issue_owner"), i.repo.alias("issue_repo"),
        i.number.alias("issue_number"), p.owner.alias("pr_owner"), p.repo.alias("pr_repo"),
        p.number.alias("pr_number"))


@register("url_ids", sql=f"""
WITH {CASES}
SELECT page_id, kind,
       CAST({group_sql('url', U.QUESTION_RE, 1)} AS BIGINT) AS question_id,
       {group_sql('url', U.VIDEO_RE, 1)} AS video_id,
       replace({group_sql('url', U.PAGE_UUID_RE, 1)}, '-', '') AS page_uuid,
       coalesce({group_sql('url', U.DOI_URL_RE, 1)}, {group_sql('url', U.DOI_PDF_RE, 1)}) AS doi
FROM url_cases""")
def q_url_ids(t: Tables) -> DataFrame:
    """#80-#83: question id, video id, wiki page uuid, DOI."""
    return X.url_cases(t).select("page_id", "kind", U.question_id("url").alias("question_id"),
                                 U.video_id("url").alias("video_id"), U.page_uuid("url").alias("page_uuid"),
                                 U.extract_doi("url").alias("doi"))


@register("rewrite_doi_url", sql=f"""
WITH {CASES},
d AS (SELECT page_id, kind, coalesce({group_sql('url', U.DOI_URL_RE, 1)}, {group_sql('url', U.DOI_PDF_RE, 1)}) AS doi
      FROM url_cases)
SELECT page_id, kind, doi, {sql_str(U.DOI_RESOLVERS[U.DEFAULT_DOI_RESOLVER])} || doi AS resolver_url
FROM d WHERE doi IS NOT NULL""")
def q_rewrite_doi_url(t: Tables) -> DataFrame:
    """#86: DOI URLs rewritten to the default open-access resolver."""
    d = X.url_cases(t).select("page_id", "kind", U.extract_doi("url").alias("doi"))
    return d.filter(F.col("doi").isNotNull()).withColumn("resolver_url", U.rewrite_doi_url(F.col("doi")))


def strip_sql(u: str) -> str:
    keep = (f"list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), "
            f"lambda p: p <> '' AND NOT regexp_matches(p, {sql_str('^' + U.TRACKER_PARAM + '(=|$)')}))")
    return (f"(regexp_extract({u}, '^([^?#]*)', 1) || CASE WHEN len({keep}) > 0 THEN '?' || "
            f"array_to_string({keep}, '&') ELSE '' END || regexp_extract({u}, '(#.*)$', 1))")


@register("strip_trackers", sql=f"SELECT page_id, url, {strip_sql('url')} AS clean_url FROM pages")
def q_strip_trackers(t: Tables) -> DataFrame:
    """#85: tracking parameters removed from every page URL."""
    return t.pages.select("page_id", "url", U.strip_trackers("url").alias("clean_url"))


# ------------------------------------------------------------ host rules

# --- fixed values: host rules of our deployment (same shape as the
# metasearch hostnames config: regex on host -> replacement / remove /
# low / high priority) ---------------------------------------------------
HOST_REPLACE = [(r"(.*\.)?example\.net$", "mirror.example.com")]
HOST_REMOVE = [r"^blog\."]
HOST_LOW = [r"(.*\.)?example\.org$"]
HOST_HIGH = [r"^m\."]
# -----------------------------------------------------------------------------


def host_rules(df: DataFrame, url: str = "url") -> DataFrame:
    """#84: rewrite / drop / rank hits by host rules."""
    h = U.host(url)
    new_host = h
    for pat, rep in reversed(HOST_REPLACE):
        new_host = F.when(h.rlike(pat), F.lit(rep)).otherwise(new_host)
    removed = F.lit(False)
    for pat in HOST_REMOVE:
        removed = removed | h.rlike(pat)
    prio = F.lit(0)
    for pat in HOST_LOW:
        prio = F.when(h.rlike(pat), F.lit(-1)).otherwise(prio)
    for pat in HOST_HIGH:
        prio = F.when(h.rlike(pat), F.lit(1)).otherwise(prio)
    new_url = F.when(new_host != h, F.concat(
        F.regexp_extract(F.col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*://)", 1), new_host,
        F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$", 1))).otherwise(F.col(url))
    return (df.withColumn("host", h).withColumn("removed", removed)
              .withColumn("priority", prio.cast("long")).withColumn("rewritten_url", new_url)
              .filter(~F.col("removed")).drop("removed"))


def _host_sql(u: str) -> str:
    return f"regexp_extract(lower(regexp_extract({u}, {sql_str(U.NETLOC_RE)}, 1)), '^(?:[^@]*@)?([^:]*)', 1)"


def host_rules_sql() -> str:
    h = "host"
    rep = "".join(f"WHEN {rx(h, p)} THEN {sql_str(r)} " for p, r in HOST_REPLACE)
    rem = " OR ".join(rx(h, p) for p in HOST_REMOVE)
    high = "".join(f"WHEN {rx(h, p)} THEN 1 " for p in HOST_HIGH)
    low = "".join(f"WHEN {rx(h, p)} THEN -1 " for p in HOST_LOW)
    return f"""
WITH a AS (SELECT page_id, url, {_host_sql('url')} AS host FROM pages),
b AS (SELECT *, CASE {rep}ELSE host END AS new_host, ({rem}) AS removed,
             CAST(CASE {high}{low}ELSE 0 END AS BIGINT) AS priority FROM a)
SELECT page_id, url, host, priority,
       CASE WHEN new_host <> host THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://)', 1) || new_host
            || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*(.*)$', 1) ELSE url END AS rewritten_url
FROM b WHERE NOT removed"""


@register("host_rules", sql=host_rules_sql())
def q_host_rules(t: Tables) -> DataFrame:
    """#84: host replace / remove / low-high priority rules on page URLs."""
    return host_rules(t.pages.select("page_id", "url")).select(
        "page_id", "url", "host", "priority", "rewritten_url")


@register("domain_filter", sql=f"""
WITH a AS (SELECT page_id, url, {_host_sql('url')} AS host FROM pages)
SELECT page_id, url FROM a
WHERE (host IN ('example.com', 'example.org') OR ends_with(host, '.example.com') OR ends_with(host, '.example.org'))
  AND NOT (host = 'blog.example.com' OR ends_with(host, '.blog.example.com') OR starts_with(host, 'blog.'))""")
def q_domain_filter(t: Tables) -> DataFrame:
    """#13: include-only and exclude host lists (suffix match)."""
    return domain_filter(t.pages.select("page_id", "url"), include=["example.com", "example.org"],
                         exclude=["blog.example.com"], exclude_prefixes=["blog."])


def domain_filter(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None,
                  url: str = "url", exclude_prefixes: list[str] | None = None) -> DataFrame:
    """#13: keep hosts equal to or under an included domain, drop excluded ones.

    Empty / None lists are ignored. Lists are configuration-sized, so each is
    compiled into the predicate (no join).
    """
    h = U.host(url)

    def under(d: str):
        return (h == d) | h.endswith("." + d)

    cond = F.lit(True)
    if include:
        inc = F.lit(False)
        for d in include:
            inc = inc | under(d)
        cond = cond & inc
    for d in exclude or []:
        cond = cond & ~under(d)
    for p in exclude_prefixes or []:
        cond = cond & ~h.startswith(p)
    return df.filter(cond)


def _under(hosts: DataFrame, domains: DataFrame, domain: str) -> DataFrame:
    """The hosts (``host``) that equal a listed domain or lie under one: every suffix is looked up."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed = domains.select(F.lower(F.col(domain)).alias("_suffix")).distinct()
    return hosts.select("host", F.explode(suffixes).alias("_suffix")).join(listed, "_suffix", "left_semi").select("host").distinct()


def domain_lists(df: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None, domain: str = "domain",
                 url: str = "url") -> DataFrame:
    """#13 for lists of any length, given as tables (a null or empty domain counts for nothing).

    Only the distinct hosts are cut into suffixes and joined with the lists; the
    rows meet the hosts that are kept, which are broadcast if they are few. A
    list that is not given, or has no rows, is ignored.
    """
    rows = df.withColumn("host", U.host(url))
    hosts = materialize(rows.select("host").distinct())
    kept = hosts
    for listed, how in ((include, "left_semi"), (exclude, "left_anti")):
        listed = listed.filter(F.col(domain) != "") if listed is not None else None
        if listed is not None and listed.limit(1).count():
            kept = kept.join(_under(hosts, listed, domain), "host", how)
    return rows.join(small(materialize(kept)), "host", "left_semi").select(*df.columns)


@register("domain_lists", sql=f"""
WITH a AS (SELECT page_id, url, {_host_sql('url')} AS host FROM pages),
inc AS (SELECT DISTINCT regexp_extract(host, '[^.]+[.][^.]+$') AS d FROM a WHERE page_id % 3 = 0),
exc AS (SELECT DISTINCT host AS d FROM a WHERE page_id % 10 = 0)
SELECT page_id, url FROM a
WHERE EXISTS (SELECT 1 FROM inc WHERE d <> '' AND (host = d OR ends_with(host, '.' || d)))
  AND NOT EXISTS (SELECT 1 FROM exc WHERE d <> '' AND (host = d OR ends_with(host, '.' || d)))""")
def q_domain_lists(t: Tables) -> DataFrame:
    """#13: pages under the domains of every third page, but not under the hosts of every tenth."""
    pages = t.pages.select("page_id", "url", U.host("url").alias("h"))
    include = pages.filter("page_id % 3 = 0").select(F.regexp_extract("h", r"[^.]+[.][^.]+$", 0).alias("domain"))
    exclude = pages.filter("page_id % 10 = 0").select(F.col("h").alias("domain"))
    return domain_lists(pages.select("page_id", "url"), include, exclude)


# ------------------------------------------------------------ clean URLs

def clean_urls(df: DataFrame, raw: str = "raw") -> DataFrame:
    """#18: a URL or a JSON array of URLs -> one row per valid http(s) URL."""
    v = F.expr(f"try_parse_json({raw})")
    is_list = F.expr(f"coalesce(startswith(schema_of_variant(try_parse_json({raw})), 'ARRAY'), false)")
    strings = F.expr(
        f"transform(filter(try_variant_get(try_parse_json({raw}), '$', 'array<variant>'), "
        f"x -> schema_of_variant(x) = 'STRING'), x -> variant_get(x, '$', 'string'))")
    del v
    cands = F.when(is_list, strings).otherwise(F.array(F.col(raw)))
    out = df.select("*", F.posexplode(cands).alias("pos", "url"))
    return out.filter(~F.col("url").rlike(r"^[ \t\n\r\f\x0B]*$") & U.url_ok("url"))


_RAW_INPUT = ("CASE page_id % 4 WHEN 0 THEN url "
              "WHEN 1 THEN '[\"' || url || '\", \"ftp://files.example.com/a\", \"  \", 5, null, \"https://\"]' "
              "WHEN 2 THEN '{\"u\": \"' || url || '\"}' ELSE 'see ' || url END")


@register("clean_urls", sql=f"""
WITH r AS (SELECT page_id, {_RAW_INPUT} AS raw FROM pages),
e AS (
  SELECT page_id, raw, CASE WHEN (CASE WHEN json_valid(raw) THEN json_type(raw) END) = 'ARRAY'
         THEN list_transform(list_filter(CAST(json_extract(raw, '$[*]') AS JSON[]), lambda x: json_type(x) = 'VARCHAR'),
                             lambda x: json_extract_string(x, '$'))
         ELSE [raw] END AS cands
  FROM r
),
x AS (SELECT page_id, raw, unnest(range(0, len(cands))) AS pos, cands FROM e)
SELECT page_id, raw, CAST(pos AS BIGINT) AS pos, cands[pos + 1] AS url FROM x
WHERE NOT regexp_matches(cands[pos + 1], '^[ \\t\\n\\r\\f\\x0B]*$')
  AND regexp_matches(cands[pos + 1], '^(?i:https?)://[^/?#]+')""")
def q_clean_urls(t: Tables) -> DataFrame:
    """#18: URL or JSON list of URLs -> valid http(s) URLs, one per row."""
    raw = t.pages.select("page_id", F.expr(_RAW_INPUT).alias("raw"))
    return clean_urls(raw).select("page_id", "raw", F.col("pos").cast("long").alias("pos"), "url")


# ------------------------------------------------------ globs and fetchers

# fixed values: globs exercised on page URLs
GLOBS = ["*article*", "*/fr/*", "*?page=*", "*#top", "http?://*.example.org/*",
         "*[0-9][0-9][0-9]*", "*[!a-z0-9/]"]


def _globs_sql(u: str) -> str:
    parts = [f"CASE WHEN regexp_matches(lower({u}), {sql_str(U.glob_regex(g.lower()))}) THEN '{i}' END"
             for i, g in enumerate(GLOBS)]
    return "concat_ws(',', " + ", ".join(parts) + ")"


@register("glob_match", sql=f"SELECT page_id, url, {_globs_sql('url')} AS matched FROM pages")
def q_glob_match(t: Tables) -> DataFrame:
    """#24: which globs match each URL (indices into ``GLOBS``)."""
    parts = [F.when(U.glob_match("url", g), F.lit(str(i))) for i, g in enumerate(GLOBS)]
    return t.pages.select("page_id", "url", F.concat_ws(",", *parts).alias("matched"))


# --- fixed values: fetch handler rules (name, URL globs, host globs,
# priority, availability: True / False / None = no handler entry) ----------
FETCH_RULES = [
    {"name": "reader", "patterns": ["*article*", "*news*"], "domains": ["*.example.com"], "priority": 2, "available": True},
    {"name": "crawler", "patterns": ["*/fr/*"], "domains": ["m.*"], "priority": 1, "available": True},
    {"name": "stealth", "patterns": ["*?page=*"], "domains": [], "priority": 1, "available": False},
    {"name": "archive", "patterns": ["*#top"], "domains": [], "priority": 1, "available": None},
    {"name": "default", "patterns": ["*"], "domains": ["*"], "priority": 999, "available": True},
]
DEFAULT_FETCHER = "default"
# -----------------------------------------------------------------------------


def _rule_match(rule: dict, url: str = "url"):
    m = F.lit(False)
    for g in rule["patterns"]:
        m = m | U.glob_match(url, g)
    for g in rule["domains"]:
        m = m | U.glob_match(U.netloc(url), g)
    return m


def _eligible(rules: list[dict]) -> list[dict]:
    """Rules in decision order: priority, then listed order; unavailable ones out."""
    ok = [(r["priority"], i, r) for i, r in enumerate(rules) if r.get("available") is not False]
    return [r for _, _, r in sorted(ok, key=lambda x: (x[0], x[1]))]


def select_fetcher(url: str = "url", rules: list[dict] = FETCH_RULES, default: str = DEFAULT_FETCHER):
    """#64: lowest priority number among matching available rules (first listed wins ties)."""
    out = F.lit(default)
    for r in reversed(_eligible(rules)):
        out = F.when(_rule_match(r, url), F.lit(r["name"])).otherwise(out)
    return out


def fallback_fetchers(primary, rules: list[dict] = FETCH_RULES):
    """#65: other available handlers with an entry, in priority order."""
    ordered = [r["name"] for r in sorted(rules, key=lambda r: r["priority"]) if r.get("available") is True]
    return F.array_remove(F.array(*[F.lit(n) for n in ordered]), primary)


def _select_sql(u: str) -> str:
    whens = []
    for r in _eligible(FETCH_RULES):
        conds = [f"regexp_matches(lower({u}), {sql_str(U.glob_regex(g.lower()))})" for g in r["patterns"]]
        conds += [f"regexp_matches(lower(regexp_extract({u}, {sql_str(U.NETLOC_RE)}, 1)), "
                  f"{sql_str(U.glob_regex(g.lower()))})" for g in r["domains"]]
        whens.append(f"WHEN {' OR '.join(conds)} THEN {sql_str(r['name'])}")
    return f"(CASE {' '.join(whens)} ELSE {sql_str(DEFAULT_FETCHER)} END)"


_FALLBACK_SQL = sql_list([r["name"] for r in sorted(FETCH_RULES, key=lambda r: r["priority"])
                          if r.get("available") is True])


@register("select_by_priority", sql=f"SELECT page_id, url, {_select_sql('url')} AS fetcher FROM pages")
def q_select_by_priority(t: Tables) -> DataFrame:
    """#64: fetch handler per URL by rule priority (first listed wins ties)."""
    return t.pages.select("page_id", "url", select_fetcher("url").alias("fetcher"))


@register("fallback_order", sql=f"""
WITH s AS (SELECT page_id, url, {_select_sql('url')} AS fetcher FROM pages)
SELECT page_id, fetcher, array_to_string(list_filter({_FALLBACK_SQL}, lambda n: n <> fetcher), ',') AS fallbacks
FROM s""")
def q_fallback_order(t: Tables) -> DataFrame:
    """#65: remaining available handlers in priority order."""
    s = t.pages.select("page_id", select_fetcher("url").alias("fetcher"))
    return s.select("page_id", "fetcher", F.array_join(fallback_fetchers(F.col("fetcher")), ",").alias("fallbacks"))


# ----------------------------------------------------------------- MIME

def _mime_sql(u: str) -> str:
    last = f"regexp_extract(regexp_extract({u}, '^([^?#]*)', 1), '([^/]*)$', 1)"
    ext = f"lower(regexp_extract({last}, {sql_str(M.EXT_RE)}, 1))"
    cases = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in M.EXT_MIME.items())
    return f"(CASE {ext} {cases} ELSE {sql_str(M.DEFAULT_MIME)} END)"


def _conv_sql(m: str) -> str:
    cases = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in M.CONVERTERS.items())
    return f"(CASE {m} {cases} ELSE {sql_str(M.DEFAULT_CONVERTER)} END)"


@register("classify_mime", sql=f"""
WITH {CASES},
m AS (SELECT page_id, kind, url, {_mime_sql('url')} AS mime FROM url_cases)
SELECT page_id, kind, mime, {_conv_sql('mime')} AS converter FROM m""")
def q_classify_mime(t: Tables) -> DataFrame:
    """#2: extension -> MIME -> converter for every URL shape."""
    m = X.url_cases(t).select("page_id", "kind", M.mime_of(F.col("url")).alias("mime"))
    return m.withColumn("converter", M.converter_of(F.col("mime")))


# Separate keys for the id extractors (same functions as ``url_ids``).
@register("question_id", sql=f"WITH {CASES}\nSELECT page_id, kind, "
          f"CAST({group_sql('url', U.QUESTION_RE, 1)} AS BIGINT) AS question_id FROM url_cases")
def q_question_id(t: Tables) -> DataFrame:
    """#80: digits after /questions/."""
    return X.url_cases(t).select("page_id", "kind", U.question_id("url").alias("question_id"))


@register("video_id", sql=f"WITH {CASES}\nSELECT page_id, kind, {group_sql('url', U.VIDEO_RE, 1)} AS video_id FROM url_cases")
def q_video_id(t: Tables) -> DataFrame:
    """#81: watch?v= / youtu.be/ / embed/ ids."""
    return X.url_cases(t).select("page_id", "kind", U.video_id("url").alias("video_id"))


@register("page_uuid", sql=f"WITH {CASES}\nSELECT page_id, kind, "
          f"replace({group_sql('url', U.PAGE_UUID_RE, 1)}, '-', '') AS page_uuid FROM url_cases")
def q_page_uuid(t: Tables) -> DataFrame:
    """#82: first 32-hex / dashed UUID, dashes removed."""
    return X.url_cases(t).select("page_id", "kind", U.page_uuid("url").alias("page_uuid"))


@register("extract_doi", sql=f"WITH {CASES}\nSELECT page_id, kind, "
          f"coalesce({group_sql('url', U.DOI_URL_RE, 1)}, {group_sql('url', U.DOI_PDF_RE, 1)}) AS doi FROM url_cases")
def q_extract_doi(t: Tables) -> DataFrame:
    """#83: DOI from doi.org URLs or PDF file names."""
    return X.url_cases(t).select("page_id", "kind", U.extract_doi("url").alias("doi"))


@register("parse_pr_url", sql=f"WITH {CASES}\nSELECT page_id, kind, "
          f"{_triple_sql(U.PR_RE, ('owner', 'repo', 'pr_number'))} FROM url_cases")
def q_parse_pr_url(t: Tables) -> DataFrame:
    """#79: pull-request URLs -> owner, repo, number (http(s), optional www./m.)."""
    p = U.parse_pr_url("url")
    return X.url_cases(t).select("page_id", "kind", p.owner.alias("owner"), p.repo.alias("repo"),
                                 p.number.alias("pr_number"))
