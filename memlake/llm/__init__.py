"""Training-data operators at corpus scale.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; the thin ``opN_<name>`` queries in ``queries.py`` apply
them, with production parameters, to whole tables.
"""
