"""Readers and writers of the candle and funding store, payloads and run logs."""
