"""Registered queries over the test tables, and the views that give those the shapes of a library."""
