"""Relational operators over versions, citations, paragraphs, rankings and labels."""
