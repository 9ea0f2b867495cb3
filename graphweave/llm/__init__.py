"""Corpus operators for training data: ten DataFrame operators and their registered queries."""
