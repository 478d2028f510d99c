"""Operators for preparing language-model training data.

Every module holds one operator (`DataFrame -> DataFrame`); `queries` registers them.
Nothing outside this folder imports it.
"""
