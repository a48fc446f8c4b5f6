"""Auditing language-model interactions with Spark."""
