"""Training-data operators: dedup, decontamination, toxicity, tokens, pages, chats.

Nothing else in the library imports this subpackage. ``queries.py`` holds its query
catalogue and ``oracles.py`` the same results in SQL where SQL can express them.
"""
