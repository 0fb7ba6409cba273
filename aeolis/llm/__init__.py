"""Preparation of text corpora for training: one module an operator."""
