"""Retail, wholesale, media and document analytics as Spark DataFrame operators."""
