"""Training-data operators: scoring, privacy, quality, duplicates of vectors, texts and lines, secrets, packing, chat, leakage, language, negatives, periodic runs."""
