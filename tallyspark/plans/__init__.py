"""Queries: operators applied to the tables of a folder, each with SQL that gives the same rows where SQL can."""
