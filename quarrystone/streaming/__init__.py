"""Streams of activity: limiter, windows, frontier."""
