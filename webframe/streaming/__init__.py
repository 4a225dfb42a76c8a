"""The stateful parts of the crawl as Structured Streaming jobs."""
