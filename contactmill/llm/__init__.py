"""Operators that turn stored texts into training data. Nothing else imports this package."""
