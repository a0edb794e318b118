"""Readers and writers: raw documents, corpus parts, vocabularies, query files, category graphs."""
