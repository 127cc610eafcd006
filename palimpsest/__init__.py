"""Conversation-archive analytics as Spark DataFrame plans."""
