"""Operators of a training-data pipeline: formatting, cleaning, deduplication, scoring, encoding and packing of texts.

Rows are identified by their id and the hash of their text (``keys``), so repeated rows and repeated ids
with other texts never mix; an id may be NULL. Only the named id and text columns are read, so further
columns, whatever their names, neither clash nor matter.
"""
