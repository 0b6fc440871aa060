"""Training-data operators: dedup, tokenisation, filters, decontamination and search.

Nothing outside this package imports it; `lodestone.llm.queries` registers its queries.
"""
