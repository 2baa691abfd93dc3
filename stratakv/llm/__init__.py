"""Training-data operators: one module per operator, each with a general interface.

Nothing outside this folder imports it; ``registry`` holds the thin queries that apply
every operator to its whole table.
"""
