"""Training-data operators: sharding, chat formatting, near-duplicates,
quality, packing, decontamination, personal data, exact search, language
and line deduplication. Nothing outside this package imports it."""
