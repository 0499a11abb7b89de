"""Training-data operators: mixing, tokens, URL rules, chat, dedup, secrets, decontamination, classifiers.

Nothing else in the library imports this subpackage.
"""
