"""Crawl settings and the fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
ROBOT_NAME = "webframe"
PRIORITY = 1
HOST_BATCH = 20
TRAFFIC_BUCKET_SECONDS = 60
TRAFFIC_MINUTES = 60
LOG_KEEP = 200
DENY_ALL_ROBOTS = "User-agent: *\nDisallow: /\n"


@dataclass(frozen=True)
class CrawlSettings:
    crawl_delay: float = 1.0
    domain_concurrency: int = 2
    host_batch: int = HOST_BATCH  # urls of a host per round
    need_fetch: bool = False  # stored urls are not fetched again, unless forced
    store: str = "first"  # which version of a page stays: "first" or "latest"
    follow_links: bool = True
    crawler_running: bool = True
    mode: str = "domains"  # or "internet": an empty allow-list restricts nothing
    robot_name: str = ROBOT_NAME
