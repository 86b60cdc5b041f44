"""Readers: tile tables, series metadata, documents."""
