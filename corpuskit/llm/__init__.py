"""Training-data operators (token counts, near-dedup, scans, mixing, packing,
language-model scores, neighbours, quality rules, page extraction).

Nothing outside this folder imports it; ``queries.py`` lists its queries.
"""
