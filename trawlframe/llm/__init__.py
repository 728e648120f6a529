"""Operators of a training-data pipeline: one module per operator, its query in the same module.

Importing ``trawlframe.llm.queries`` registers the queries; nothing outside of
this subpackage imports it.
"""
