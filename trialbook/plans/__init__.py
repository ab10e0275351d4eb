"""Composed plans.  Effects (move, delete, cancel, send) come out as rows of planned actions and are never performed."""
