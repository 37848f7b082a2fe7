"""Training-data operators: search, near copies, filters, tokens, packing, quality, language and archives."""
