"""Operators for training-data pipelines over model responses and documents.

Nothing outside this subpackage imports it.
"""
