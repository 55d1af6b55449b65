"""Training-data operators over document, benchmark and conversation tables."""
