"""Training-data operators: dedup, tokenization, scoring, filtering, extraction.

Nothing outside this subpackage imports it; its queries live in
``cladespark.llm.queries``.
"""
