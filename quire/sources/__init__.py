"""Quire sources."""
