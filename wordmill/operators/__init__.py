"""Relational operators: counting, bucketing and shuffle views."""
