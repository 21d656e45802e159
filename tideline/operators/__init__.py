"""Operators over keyed (symbol, ts, ...) frames."""
