"""The batch state kept between runs, as Structured Streaming jobs."""
