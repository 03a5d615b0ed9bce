"""Training-data operators: sharding, packing, PII, token files, quality rules, mixing,
language identification, near-duplicate detection and token counts.

Nothing outside this subpackage imports it; ``voxmill.llm.entry`` lists its queries.
"""
