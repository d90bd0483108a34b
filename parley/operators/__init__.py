"""DataFrame operators on documents, turns and transcripts."""
