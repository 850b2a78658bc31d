"""Training-data operators: language, leaks, secrets, tokens, duplicates, quality.

Nothing outside this subpackage imports it. ``shared.prepare`` ships the package to the executors'
Python once a session, so that they need no installed copy.
"""
