"""Operators for preparing training data from the catalogues' texts and records."""
