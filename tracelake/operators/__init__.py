"""Relational operators over artifacts, events and detections."""
