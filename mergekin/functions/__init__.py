"""String-similarity, phonetic, vector and statistical functions."""
