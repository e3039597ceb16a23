"""Operators for preparing language-model training data.

Every operator takes and returns DataFrames.  None of the other subpackages
imports this one, so it can be removed without affecting the contract engine.
"""
