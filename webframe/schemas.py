"""Table schemas, as DDL strings."""

RESPONSES = (
    "url string, code int, headers map<string,string>, body binary, "
    "request_time double, crawl_time timestamp"
)
DOCS = (
    "url string, domain string, code int, body string, links array<string>, "
    "headers map<string,string>, content_type string, crawl_time timestamp"
)
FRONTIER = "url string, host string, priority int, force boolean, added_at timestamp"
SEEN = "url string"
DOMAINS = "domain string, enabled boolean, crawl_delay double"
CUSTOM_RULES = "id string, site string, ord long, flag boolean, path string"
ROBOTS_TXT = "robots_url string, host string, code int, content string"
ROBOTS_RULES = (
    "robots_url string, host string, group_no int, agents array<string>, rule_no int, "
    "allow boolean, path string, pattern string, crawl_delay double"
)
METRIC_EVENTS = "key string, value double, ts timestamp"
LOG = "ts timestamp, message string"
EDGES = "src string, dst string, pos int"
