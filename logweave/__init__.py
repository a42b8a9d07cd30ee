"""Sharded append-only event logs as DataFrame and Structured Streaming programs."""
