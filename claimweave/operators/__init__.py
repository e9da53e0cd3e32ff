"""Operators over claim graphs and edge tables."""
