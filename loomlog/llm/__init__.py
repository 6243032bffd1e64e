"""Operators on texts and conversations for training data. Nothing outside this folder imports it."""
