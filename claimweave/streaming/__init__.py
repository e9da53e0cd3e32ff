"""Claim streams: view maintenance, newest values, event tagging."""
