"""No streaming operator: every query of this engine is a batch query over a snapshot.

The result tables are ordinary DataFrames, so a user can feed them to
``foreachBatch`` like any other frame.
"""
