"""Operators: ``DataFrame -> DataFrame`` over the envelope user_key, seq, ts, tz."""
