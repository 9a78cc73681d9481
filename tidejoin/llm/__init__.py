"""Operators for preparing training data: tokens, search, languages, copies, mixtures, toxicity, licences, language models."""
