"""Loan-portfolio risk analytics as PySpark DataFrame jobs."""
