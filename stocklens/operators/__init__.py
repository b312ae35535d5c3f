"""Analytical operators: each takes domain tables and returns a lazy DataFrame."""
