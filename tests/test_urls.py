"""URL parsing and routing on invented URLs: hosts, schemes, shapes and malformed input."""

from pyspark.sql import functions as F

from corpuskit.functions import urls as U

ISSUE_OK = [f"{scheme}://{host}github.com/{path}/issues/{n}" for scheme in ("http", "https") for host in ("", "www.", "m.")
            for path, n in (("acme/rocket", "7"), ("a-b-c/d_e.f", "20481"))]
ISSUE_OK += ["https://github.com/acme/rocket/issues/7#event-1", "https://github.com/acme/rocket/issues/7?q=is%3Aopen"]
ISSUE_BAD = ["", "plain words", "https://github.com/acme", "https://github.com/acme/rocket", "https://github.com/acme/rocket/issues",
             "https://github.com/acme/rocket/issues/new", "https://github.com/acme/rocket/pull/7",
             "https://codeberg.org/acme/rocket/issues/7", "https://github.com/acme/rocket/releases/7"]
PARSES = {
    "https://github.com/acme/rocket": ("acme", "rocket", None, None),
    "https://github.com/acme/rocket/blob/trunk/engine/nozzle.rs": ("acme", "rocket", "trunk", "engine/nozzle.rs"),
    "https://github.com/acme/rocket/tree/next/manual": ("acme", "rocket", "next", "manual"),
    "https://github.com/acme/rocket/raw/v2.1/plan.toml": ("acme", "rocket", "v2.1", "plan.toml"),
    "https://github.com/acme/rocket/commit/0f1e2d/engine/pump.c": ("acme", "rocket", "0f1e2d", "engine/pump.c"),
    "github.com/a-b/c_d/blob/wip/x.py": ("a-b", "c_d", "wip", "x.py"),
    "https://raw.githubusercontent.com/acme/rocket/trunk/NOTES.md": ("acme", "rocket", "trunk", "NOTES.md"),
    "https://raw.githubusercontent.com/acme/rocket/refs/heads/next/NOTES.md": ("acme", "rocket", "refs/heads/next", "NOTES.md"),
    "raw.githubusercontent.com/acme/rocket/trunk/a/b/c.txt": ("acme", "rocket", "trunk", "a/b/c.txt"),
    "https://nowhere.test/acme/rocket": None,
}
REPO_OK = [u for u, want in PARSES.items() if want] + ["http://raw.githubusercontent.com/acme/rocket/trunk/doc/index.rst"]
REPO_BAD = ["", "plain words", "https://nowhere.test", "https://codeberg.org/acme/rocket", "ftp://github.com/acme/rocket",
            "https://github.com/acme/rocket/issues/7", "https://github.com/acme/rocket/pull/7",
            "https://raw.nowhere.test/acme/rocket/trunk/x.py"]
VIDEOS = {f"https://{form}": "Ab3_-xYz019" for form in (
    "www.youtube.com/watch?v=Ab3_-xYz019", "youtu.be/Ab3_-xYz019", "www.youtube.com/embed/Ab3_-xYz019",
    "www.youtube.com/watch?v=Ab3_-xYz019&t=9")} | {"https://nowhere.test/watch": None}
_ID = "0a1b2c3d4e5f60718293a4b5c6d7e8f9"
WIKI = {f"https://www.notion.so/team/{_ID}": _ID, f"https://notion.so/team/{_ID}?v=2": _ID,
        f"https://www.notion.so/Some-Title-{_ID}": _ID,
        "https://www.notion.so/0a1b2c3d-4e5f-6071-8293-a4b5c6d7e8f9": _ID, "https://www.notion.so/team/short": None}


def _one(spark, urls, col):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    return {r["url"]: r["v"] for r in df.select("url", col.alias("v")).collect()}


def test_issue_urls(spark):
    got = _one(spark, ISSUE_OK + ISSUE_BAD, U.parse_issue_url("url").isNotNull())
    assert all(got[u] for u in ISSUE_OK)
    assert not any(got[u] for u in ISSUE_BAD)


def test_repo_urls(spark):
    got = _one(spark, REPO_OK + REPO_BAD, U.parse_repo_url("url").isNotNull())
    assert all(got[u] for u in REPO_OK)
    assert not any(got[u] for u in REPO_BAD)


def test_repo_parse(spark):
    got = _one(spark, list(PARSES), U.parse_repo_url("url"))
    for u, want in PARSES.items():
        r = got[u]
        assert (None if r is None else (r.owner, r.repository, r.branch_or_commit, r.path)) == want, u


def test_video_ids(spark):
    assert _one(spark, list(VIDEOS), U.video_id("url")) == VIDEOS


def test_wiki_ids(spark):
    assert _one(spark, list(WIKI), U.page_uuid("url")) == WIKI


def test_routes(spark):
    cases = {"https://stackoverflow.com/questions/1/x": "stackoverflow", "https://x.org/?u=doi.org": "library",
             "https://youtu.be/abc": "video", "https://www.notion.so/P-12345678abcd1234abcd1234abcd1234": "wiki",
             "https://github.com/a/b/issues/3": "issue", "https://github.com/a/b/pull/3": "pull_request",
             "https://github.com/a/b": "repo", "https://arxiv.org/abs/1": "generic", "https://example.com": "generic"}
    assert _one(spark, list(cases), U.route_url("url")) == cases
    held = _one(spark, ["https://arxiv.org/abs/1"], U.route_url("url", F.lit(True)))
    assert held["https://arxiv.org/abs/1"] == "library"


def test_glob_and_trackers(spark):
    assert U.glob_regex("*news*") == "(?is)^.*news.*$"
    got = _one(spark, ["https://a.com/x?utm_source=y&page=2&ref=z#top", "https://a.com/?fbclid=1"],
               U.strip_trackers("url"))
    assert got["https://a.com/x?utm_source=y&page=2&ref=z#top"] == "https://a.com/x?page=2#top"
    assert got["https://a.com/?fbclid=1"] == "https://a.com/"
