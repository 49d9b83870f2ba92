"""Training-data operators: media, PII, tokenizers, language ID, decontamination,
similarity join, licence scan, URL filter, token counts and chat formatting.

Nothing else in the library imports this subpackage.
"""
