"""Relational operators over reports, cells, rankings and answers."""
