"""Continuous maintenance as Structured Streaming jobs, and batch twins to compare them with."""
