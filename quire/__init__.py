"""Quire: bibliographic analytics as DataFrame and Column operations on Spark."""
