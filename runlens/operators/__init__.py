"""Relational operators over the long table ``samples(run_id, seq, t, metric, value)``.

``seq`` is the dense row number in the run file; all rows of one file line
share it.  ``t`` is seconds.
"""
