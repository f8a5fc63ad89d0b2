"""Registered queries with their SQL, and the relations they start from."""
