"""Support-ticket analytics as Spark DataFrame operators.

``functions``  Column -> Column (text, labels, dates, prompts, replies)
``sources``    readers and writers (landed tables, snapshots, error log)
``operators``  DataFrame -> DataFrame (threads, breakdowns, enrichment, baselines)
``plans``      the two whole runs: analyse tickets, report on a snapshot
"""
