"""Spark jobs for evidence retrieval and conversation-quality analytics."""
