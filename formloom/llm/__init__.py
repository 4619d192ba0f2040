"""Training-data operators.

One module per operator (`op01_...` to `op10_...`) with its general interface,
and `queries.py`, which holds the thin contract queries.  Nothing outside this
package imports it.
"""
