"""Training-data operators for large text corpora.

Nothing outside this subpackage imports it.  Each module holds one operator with a general interface;
``registry`` lists the thin queries and their SQL.
"""
