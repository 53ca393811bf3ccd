"""Operators of a training-data pipeline over text, one module each; nothing else imports this."""
