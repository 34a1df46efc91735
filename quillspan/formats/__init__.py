"""Parsers of file formats. Each turns the bytes of one input into the rows of one tree; ``parse`` runs them on tables."""
