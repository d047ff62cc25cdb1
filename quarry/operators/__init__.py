"""Operators over catalogue tables: merge, numbering, retention, views, sinks."""
