"""Readers that turn registries, taxonomies, pages and feeds into flat tables."""
