"""Structured Streaming counterparts: extras beside the batch operators."""
