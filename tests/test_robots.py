import random
import re

import pytest

from webframe import schemas
from webframe.operators import robots as R


def parsed(frame, text, **kw):
    return R.parse_robots(frame([("http://h/robots.txt", "h", 200, text)], schemas.ROBOTS_TXT), **kw)


def allowed(frame, text, paths, agent="webframe", custom=(), target="path", **kw):
    own = R.custom_ruleset(frame([(str(i), "h", o, f, p) for i, (o, f, p) in enumerate(custom)], schemas.CUSTOM_RULES))
    urls = frame([(i, "http://h" + p) for i, p in enumerate(paths)], "i int, url string")
    rules = R.select_ruleset(parsed(frame, text, **kw), agent)
    return [r.allowed for r in R.robots_allowed(urls, rules, own, target=target).orderBy("i").collect()]


FILES = """
User-agent: Harvest Bot
Disallow: /drafts/*.txt$
Allow: /drafts
Disallow: /*;v=

User-agent: *
Disallow: /cgi
"""
PATHS = ["/", "/drafts/one.txt", "/drafts/one.txt.gz", "/list;v=2", "/cgi/x", "/own/page"]


def test_wildcards_and_custom_rules(frame):
    urls = [True, False, True, True, True, False]  # parameters are not part of the path
    assert allowed(frame, FILES, PATHS, "harvest bot", [(1, False, "/own/")]) == urls
    assert allowed(frame, FILES, PATHS, "harvest bot", target="full")[3] is False
    assert allowed(frame, FILES, PATHS, "another") == [True, True, True, True, False, True]


def test_deny_all(frame):
    assert allowed(frame, "User-agent: *\nDisallow: /\n", PATHS) == [False] * len(PATHS)


@pytest.mark.parametrize(
    "text, want",
    [
        ("User-agent: *\nDisallow: /a\n\nUser-agent: webframe\nDisallow: /b", [False, True]),  # first in file order
        ("User-agent: x\n\n# note\nUser-agent: WebFrame\nDisallow: /a", [False, True]),  # two agents share rules
        ("Disallow: /a\nUser-agent: other\nDisallow: /b", [True, True]),  # rules before any agent
        ("User-agent: *\nDisallow:\n\nUser-agent: *\nDisallow: /", [True, True]),  # a group without rules applies
        ("User-agent: *\nDisallow: /a$\nDisallow: /bc", [False, True]),
        ("User-agent: * # all\r\nAllow: /a\r\nDisallow: /\r\n", [True, False]),  # first match decides
        ("User-agent: *\nCrawl-delay: 1\nUser-agent: other\nDisallow: /", [True, True]),  # any line ends the agents
        ("User-agent: *\nno colon\nUser-agent: other\nDisallow: /a", [False, True]),  # but not lines without ':'
        ("User-agent:\nDisallow: /", [True, True]),  # no name
        ("", [True, True]),
        (None, [True, True]),
    ],
)
def test_groups(frame, text, want):
    assert allowed(frame, text, ["/a", "/b"]) == want


def test_lenient_tokens(frame):
    text = "User-agent: *\nlow: /a\n: /b\ndis: /\n"
    assert allowed(frame, text, ["/a", "/b", "/c"]) == [True, True, False]
    assert allowed(frame, text, ["/a", "/b", "/c"], lenient_tokens=False) == [True, True, True]


def test_rule_rows(frame):
    got = parsed(frame, "User-agent: a\nUser-agent: b\nAllow: /x.y*z$\nCrawl-delay: 2\nCrawl-delay: bad\n\nUser-agent: c").collect()
    assert [tuple(r)[2:] for r in got] == [
        (1, ["a", "b"], 1, True, "/x.y*z$", r"^/x\.y.*z$", 2.0),
        (2, ["c"], None, None, None, None, None),
    ]


def test_pattern_texts(frame):
    paths = ["/a.b", "/a+(b)", "/[x]{1}", "/a|b^c", "/a\\b$", "/*.php$", "/$a"]
    rules = parsed(frame, "User-agent: *\n" + "".join(f"Disallow: {p}\n" for p in paths)).collect()
    want = [r"^/a\.b", r"^/a\+\(b\)", r"^/\[x\]\{1\}", r"^/a\|b\^c", r"^/a\\b$", r"^/.*\.php$", r"^/\$a"]
    assert [r.pattern for r in rules] == want


def decided(spark, rules, targets):
    """Which targets each rule path matches, by the operator's own expression."""
    listed = R._gathered(R._cut(spark.createDataFrame([(i, 1, False, p) for i, p in enumerate(rules)], "k int, rule_no int, allow boolean, path string")), "k")
    rows = listed.crossJoin(spark.createDataFrame([(t,) for t in targets], "t string"))
    got = rows.select("k", "t", R._match("rules", "t").isNotNull().alias("hit")).collect()
    return {(rules[r.k], r.t): r.hit for r in got}


def test_wildcards_match_as_regular_expressions(spark):
    rng = random.Random(3)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    rules = list({"/" + text(7, "ab**$.") for _ in range(150)} | {"/a*$", "/*$", "/*a*b$", "/**", "/a$", "/$$"})
    targets = list({"/" + text(9, "aaabb.$\n") for _ in range(150)} | {"/", "/a", "/a\n", "/ab\n"})
    for (rule, target), hit in decided(spark, rules, targets).items():
        body = rule[:-1] if rule.endswith("$") else rule
        pattern = ".*".join(map(re.escape, body.split("*"))) + ("$" if rule.endswith("$") else "")
        assert hit == bool(re.match(pattern, target)), (rule, target)


def test_many_wildcards_on_a_long_path_take_no_time(spark):
    import time

    decided(spark, ["/a"], ["/a"])
    began = time.time()
    rule, target = "/" + "*a" * 20 + "*b", "/" + "a" * 2000
    assert decided(spark, [rule, rule[:-1] + "a"], [target]) == {(rule, target): False, (rule[:-1] + "a", target): True}
    assert time.time() - began < 30  # backtracking would take hours


def test_full_target(frame):
    text = "User-agent: *\nDisallow: /*?sessionid\nDisallow: /a b\nDisallow: /c%2Fd"
    paths = ["/x?sessionid=1", "/a%20b", "/c%2fd", "/c/d", "", "?sessionid"]
    assert allowed(frame, text, paths, target="full") == [False, False, False, True, True, False]
    assert allowed(frame, text, paths) == [True, True, True, True, True, True]


def test_custom_rules_in_many_lists(frame, monkeypatch):
    monkeypatch.setattr(R, "RULES_PER_LIST", 2)
    custom = [(i, i % 3 == 0, f"/{i}") for i in range(1, 10)] + [(50, False, "/5"), (60, False, "/")]
    paths = [f"/{i}" for i in range(10)] + ["/1"]
    want = [False] + [i % 3 == 0 for i in range(1, 10)] + [False]
    assert allowed(frame, "", paths, custom=custom) == want


def test_status_policy(frame):
    rows = [("u", "h", c, "User-agent: *\n") for c in (200, 204, 401, 403, 404, 500, None)]
    t = frame(rows, schemas.ROBOTS_TXT)
    text, deny = "User-agent: *\n", "User-agent: *\nDisallow: /\n"
    got = [r.content for r in R.robots_status_policy(t, "standalone").collect()]
    assert got == [text, text, deny, deny, "", "", ""]
    assert [r.content for r in R.robots_status_policy(t).collect()] == [text, "", "", "", "", "", ""]


def test_meta(frame):
    text = "Sitemap: http://a/1\nUser-agent: x\nCrawl-delay: x\nUser-agent: y\nCrawl-delay: 1\nCrawl-delay: 2.5\nSitemap: http://a/2\n"
    got = R.robots_meta(frame([("u", "h", 200, text)], schemas.ROBOTS_TXT)).select("agents", "crawl_delay", "sitemap").collect()
    assert [tuple(r) for r in got] == [([], None, "http://a/2"), (["x"], None, "http://a/2"), (["y"], 2.5, "http://a/2")]


def test_urls_of_other_schemes_use_their_own_file(frame):
    rules = R.select_ruleset(parsed(frame, "User-agent: *\nDisallow: /"))
    urls = frame([("http://h/a",), ("https://h/a",), ("http://h:8/a",)], "url string")
    got = {r.url: r.allowed for r in R.robots_allowed(urls, rules).collect()}
    assert got == {"http://h/a": False, "https://h/a": True, "http://h:8/a": False}


def read_groups(text):
    """Groups of (agents, (allow, path) rules, delay) by a plain reading of the lines."""
    named = []
    for line in text.split("\n"):
        token, colon, value = line.strip().split("#")[0].partition(":")
        if colon:
            named.append((token.strip().lower(), value.replace("\t", " ").strip()))
    out, after_agent = [], False
    for token, value in named:
        agent = token in ("useragent", "user-agent")
        if not out or (agent and not after_agent):
            out.append(([], [], [None]))
        agents, rules, delay = out[-1]
        after_agent = agent
        if agent and value:
            agents.append(value)
        kind = next((d for d in ("allow", "disallow", "sitemap", "crawl-delay") if token in d), None)
        if not agent and value and kind in ("allow", "disallow"):
            rules.append((kind == "allow", value))
        if not agent and kind == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?", value):
            delay[0] = float(value)
    return [(a, r, d[0]) for a, r, d in out]


def test_random_files(spark):
    rng = random.Random(9)
    tokens = ["User-agent", "useragent ", "Allow", "Disallow", "allow", "dis", "", "Sitemap", "map", "Crawl-delay", "delay", "X"]
    values = ["*", "webframe", " other", "/", "/a*", "", "\t/b$", "2", "1.5", "x y", "#", "/c # d", ":e"]
    line = lambda: rng.choice(["", "# z", "nothing", f"{rng.choice(tokens)}:{rng.choice(values)}"])
    texts = [rng.choice(["\n", "\r\n"]).join(line() for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(str(i), "h", 200, t) for i, t in enumerate(texts)], schemas.ROBOTS_TXT)
    got = {}
    for r in R.parse_robots(df).orderBy("robots_url", "group_no", "rule_no").collect():
        groups = got.setdefault(int(r.robots_url), [])
        if len(groups) < r.group_no:
            groups.append((r.agents, [], r.crawl_delay))
        if r.rule_no is not None:
            groups[-1][1].append((r.allow, r.path))
    for i, text in enumerate(texts):
        assert got.get(i, []) == read_groups(text), text


def first_match(rules, target):
    """allow of the first rule (number, allow, path) whose pattern matches; True where none does."""
    for _, allow, path in sorted(rules):
        body = path[:-1] if path.endswith("$") else path
        if re.match(".*".join(map(re.escape, body.split("*"))) + ("$" if path.endswith("$") else ""), target):
            return allow
    return True


def test_indexed_rules_equal_reading_them_one_by_one(frame, monkeypatch):
    """A site with very many rules beside one with few: verdicts by the index, equal rules counted once."""
    monkeypatch.setattr(R, "RULES_PER_LIST", 3)
    rng = random.Random(8)
    heads = ["/", "/a", "/ab", "/b/", "/abc", "/é", "*"]
    path = lambda: rng.choice(heads) + rng.choice(["", "*", "*a", "*b*c"]) + rng.choice(["", "$", "c$", "*é$"])
    rules = {site: [(i, rng.random() < 0.5, path()) for i in range(1, n)] for site, n in (("h", 120), ("g", 3))}
    rows = [(f"{site}{i:04}", site, i, allow, p) for site, of in rules.items() for i, allow, p in of]
    own = R.custom_ruleset(frame(rows, schemas.CUSTOM_RULES))
    targets = {"/" + "".join(rng.choice("abcé/\n") for _ in range(rng.randint(0, 7))) for _ in range(150)}
    urls = [(f"http://{site}{t}", t, site) for t in targets for site in "hg"]
    df = frame([u[:2] for u in urls], "url string, target string")
    monkeypatch.setattr(R.U, "path", lambda c: R.F.col("target"))
    monkeypatch.setattr(R.U, "host", lambda c: R.F.regexp_extract(c, "^http://([a-z]*)", 1))
    lists = R.rule_lists(R.select_ruleset(R.parse_robots(frame([], schemas.ROBOTS_TXT))), own)
    assert lists.index is not None and {r.site for r in lists.lengths.collect()} == {"h"}
    got = {(r.url, r.target): r.allowed for r in R.robots_allowed(df, lists).collect()}
    for url, target, site in urls:
        assert got[(url, target)] == first_match(rules[site], target), (target, site)


def test_rules_of_one_site_are_numbered_over_many_blocks(frame, spark):
    rows = [(f"{i % 7}-{i}", "h" if i % 3 else f"s{i % 5}", (i * 37) % 50, True, f"/{i}") for i in range(400)]
    rows += [("x", None, 1, True, "/n"), ("y", None, None, True, "/m"), ("z", "h", 1, True, "")]
    got = R.custom_ruleset(frame(rows, schemas.CUSTOM_RULES))
    plan = got._jdf.queryExecution().analyzed().toString()
    want = {}
    for i, site, order, _, path in sorted(rows, key=lambda r: (r[2] is not None, r[2], r[0])):
        if path:
            want[(site, path)] = 1 + sum(1 for s, _ in want if s == site)
    assert {(r.site, r.path): r.rule_no for r in got.collect()} == want
    assert "partitionBy" not in plan or "_block" in plan


def test_urls_meet_only_rules_of_their_own_prefixes(frame, monkeypatch):
    """2000 rules of one site with heads of their own: each url meets one of them, not all."""
    own = R.custom_ruleset(frame([(str(i), "h", i, False, f"/{i:04}*x") for i in range(2000)], schemas.CUSTOM_RULES))
    lists = R.rule_lists(R.select_ruleset(R.parse_robots(frame([], schemas.ROBOTS_TXT))), own)
    assert max(len(r.rules) for r in lists.index.collect()) == 1
    urls = frame([(f"http://h/{i:04}/{'x' if i % 2 else 'y'}",) for i in range(0, 4000, 5)], "url string")
    got = {r.url: r.allowed for r in R.robots_allowed(urls, lists).collect()}
    assert all(got[u] == (not (u.endswith("x") and int(u[9:13]) < 2000)) for u in got) and not all(got.values())
    # the join's rows: one length occurs, so a url asks once, and meets its own rule at most
    keyed = urls.selectExpr("url AS _indexed_url", "'h' AS _site", "substring(url, 9) AS _target")
    assert R._indexed_verdicts(keyed, lists).count() == sum(not v for v in got.values())
