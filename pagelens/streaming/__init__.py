"""Structured Streaming forms of the event statistics and the circuit breaker."""
