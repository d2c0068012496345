"""Operators of a training-data pipeline: sharding, language id, token counts, secrets, media, near copies,
decontamination, mixing, toxicity and chat repair.  Nothing outside this subpackage imports it."""
