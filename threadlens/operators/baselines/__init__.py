"""Offline answers to the questions the model calls ask.

Each baseline is defined exactly and computed by Spark over whole tables. They
approximate a model's judgement and are not equivalent to it.
"""
