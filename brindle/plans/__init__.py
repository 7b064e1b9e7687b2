"""Registered plans."""
