"""Structured Streaming: checkpointed delivery to several sinks, stateful matching."""
