"""Whole reports: operators composed over the bound tables, one function per query."""
