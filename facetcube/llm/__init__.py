"""Operators for language-model training data and the sketches they rest on. Nothing outside this folder imports it."""
