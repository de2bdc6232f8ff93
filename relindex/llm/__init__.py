"""Training-data operators: fingerprints, scoring, deduplication, decontamination,
URL rules, language identification, personal data, quality, source mixing,
conversation tries and embedding whitening.

Nothing else in the library imports this subpackage.
"""
