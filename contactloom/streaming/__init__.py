"""Structured Streaming over contacts and events: an extension beyond the tools, which read finished files."""
