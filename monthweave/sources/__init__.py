"""Typed readers and writers of the four tables, and their stand-in over order data."""
