"""Training-data operators over document and conversation tables."""
