"""Operators for large text corpora, each in a module of its own.

Conventions that hold for all of them:

* A row is identified by ``doc_id`` and its text. Rows that agree in both are
  one document written twice and get equal results; rows that share only the
  ``doc_id`` are different documents.
* Null text counts as empty text, null ``doc_id`` is a value of its own.
* Columns that an operator does not need are never looked at, so any extra
  column may be present under any name.
"""
