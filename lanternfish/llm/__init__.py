"""Training-data operators: decontamination, WARC, quality, tokens, dedup, toxicity, secrets, chat, licences.

Nothing outside this package imports it; ``queries.py`` lists what it offers.
"""
