"""Composed plans: entities bound to plain tables, and a query with its SQL for each operator."""
