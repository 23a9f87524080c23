"""deskmill: the data work of a privacy-first front desk, as PySpark jobs.

Masking of personal data, intent extraction, dialogue context, request checks,
calendar conflicts, free-slot search, booking admission and task timelines, all
written as DataFrame operations over whole tables and as Structured Streaming.
"""
