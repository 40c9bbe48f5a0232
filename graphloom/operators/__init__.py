"""Graph and retrieval operators over node and edge tables."""
