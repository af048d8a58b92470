"""The same operators over unbounded input."""
