"""Registered queries; importing this package registers all of them."""

from pagemill.plans import audit_queries, content_queries, graphics_queries, index_queries, letter_queries, page_queries, quality_queries, registry, report_queries, search_queries, sink_queries, stream_queries, tooling_queries

__all__ = ["audit_queries", "content_queries", "graphics_queries", "index_queries", "letter_queries", "page_queries", "quality_queries", "registry", "report_queries", "search_queries", "sink_queries", "stream_queries", "tooling_queries"]
