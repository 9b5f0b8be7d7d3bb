"""Readers and writers of reports, tables, questions and answers."""
